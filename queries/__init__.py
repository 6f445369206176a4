"""Registered queries: one Spark function and, where SQL can say it, one DuckDB statement per name."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
