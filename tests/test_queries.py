"""Registered queries against DuckDB on the smallest data (tools/check.py compares all of them on any data)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

SF = Path("/root/testdata/sf0.001")
QUICK = ["returns", "rsi", "regimes", "market_features", "normalize_article", "crawl_dedup", "clean_news", "normalize_url",
         "dedup_exact", "near_title_candidates", "time_band_pairs", "assign_trade_dates", "daily_text_features", "daily_embeddings",
         "main_table", "standardize", "top_links", "extract_articles", "evaluate_groups", "strategy_metrics"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SF.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for path in SF.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    df = entry.queries()[name](spark, str(SF))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
