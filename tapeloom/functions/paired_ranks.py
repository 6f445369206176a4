"""Sums of products of average ranks for several groupings at once.

Rows are dealt out by buckets of the first value, ranked there for all group columns, then by buckets of the second one. A
rank is the rows of its group in lower buckets plus the place inside the bucket, so every row travels twice, whatever the
number of group columns. A value that holds much more than a bucket is a bucket of its own: its rank needs no order, so its
rows go to any task.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window, functions as F, types as T

ROWS = 200_000  # rows of a bucket
PARTS = 64  # tasks that share the rows of a frequent value


def _splits(df, value, buckets):
    """Bounds of the buckets, and which buckets hold one value only."""
    points = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, points, 4 * buckets)).first()[0] or []
    often = [v for v, n in Counter(found).items() if n > 1]
    splits = [float("-inf"), *sorted({*found, *(float(np.nextafter(v, np.inf)) for v in often)}), float("inf")]
    return splits, [i for i, v in enumerate(splits) if v in often]


def _placed(df, value, splits, alone):
    """Add ``_bucket`` and ``_part``; rows without the value are in the first bucket."""
    df = df.withColumn("_at", F.coalesce(value, F.lit(0.0)))
    place = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(df) if len(splits) > 2 else df.withColumn("_bucket", F.lit(0))
    bucket = F.when(F.col(value).isNull(), 0).otherwise(F.col("_bucket").cast("int"))
    place = place.withColumn("_bucket", bucket).withColumn("_alone", F.col("_bucket").isin(alone) if alone else F.lit(False))
    part = F.when(F.col("_alone"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))).otherwise(0).cast("int")
    return place.withColumn("_part", part).drop("_at")


def _below(counted, by, weight):
    """Per group and bucket its rows ``n`` and those in lower buckets ``below``, once for every part of the bucket."""
    order = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.when(F.col("_alone"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    counts = counted.groupBy(*by, "_bucket", "_alone").agg(F.sum(weight).alias("n"))
    counts = counts.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)))
    names = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by[:-2])]  # names of their own: the other side of a cogroup holds the same columns
    return counts.select(*names, *by[-2:], F.col("_bucket").alias("_bucket"), "below", "n", F.explode(parts).alias("_part"))


def _codes(columns):
    """One number per row of some columns, each given in pieces; equal rows have equal numbers."""
    total = None
    for pieces in columns:
        whole = pa.concat_arrays([c for p in pieces for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])])
        coded = whole.dictionary_encode(null_encoding="encode")
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = at if total is None else np.unique(total * len(coded.dictionary) + at, return_inverse=True)[1]
    return total


def _ranks(rows, sides, keys, column, values, weights):
    """Codes of the rows' groups of ``column``, their average ranks, and whether they are in a group."""
    n = rows.num_rows
    sides = sides.filter(pc.equal(sides["group_column"], column))
    codes = _codes([[rows[k], sides[f"_by{i}"]] for i, k in enumerate(keys)] + [[rows[column], sides["group_value"]]])
    size = int(codes.max()) + 1
    below, held = np.zeros(size), np.zeros(size)
    below[codes[n:]], held[codes[n:]] = sides["below"].to_numpy(), sides["n"].to_numpy()
    codes, inside = codes[:n], ~rows[column].is_null().to_numpy()
    if n and rows["_alone"][0].as_py():
        return codes, below[codes] + (held[codes] + 1) / 2.0, inside
    order = np.lexsort((values, codes))
    c, v, w = codes[order], values[order], weights[order]
    group = np.r_[True, c[1:] != c[:-1]][:n]
    tie = group | np.r_[True, v[1:] != v[:-1]][:n]
    upto = np.cumsum(w) - w
    starts = np.flatnonzero(tie)
    ties = np.add.reduceat(w, starts) if n else w
    first = np.cumsum(tie) - 1
    place = upto[starts][first] - np.maximum.accumulate(np.where(group, upto, 0)) + (ties[first] + 1) / 2.0
    ranks = np.empty(n)
    ranks[order] = below[c] + place
    return codes, ranks, inside


def _firsts(codes):
    """The codes there are and the first row of each."""
    return np.unique(codes, return_index=True)


def _numbers(table, name):
    return table[name].to_numpy().astype(np.float64)


def _ranked(keys, columns, first, second, weight):
    """Rows of a bucket of ``first`` become one row per group, all columns and ``second``: rows ``w`` and sums ``a<i>`` of ranks.

    Rows without ``second`` hold the sums of squares of the ranks of a group in the column that is not NULL.
    """

    def run(rows, sides):
        values, other, w = _numbers(rows, first), _numbers(rows, second), _numbers(rows, weight)
        out, ranks = [], []
        for i, column in enumerate(columns):
            codes, rank, inside = _ranks(rows, sides, keys, column, values, w)
            ranks.append(w * rank)
            found, at = _firsts(codes[inside])
            at = np.flatnonzero(inside)[at]
            squares = np.bincount(codes[inside], (w * rank * rank)[inside])[found] if len(at) else np.empty(0)
            group = rows.take(pa.array(at))
            none = pa.nulls(len(at))
            out.append(pa.table({**{k: group[k] for k in keys}, **{c: group[c] if c == column else none.cast(pa.int32()) for c in columns},
                                 second: none.cast(pa.float64()), "w": np.zeros(len(at)),
                                 **{f"a{j}": squares if j == i else np.zeros(len(at)) for j in range(len(columns))}}))
        codes = _codes([[rows[c]] for c in [*keys, *columns]])
        order = np.lexsort((other, codes))
        c, v = codes[order], other[order]
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (v[1:] != v[:-1])])
        group = rows.take(pa.array(order[starts]))
        out.append(pa.table({**{k: group[k] for k in [*keys, *columns, second]}, "w": np.add.reduceat(w[order], starts),
                             **{f"a{j}": np.add.reduceat(r[order], starts) for j, r in enumerate(ranks)}}))
        return pa.concat_tables(out, promote_options="permissive")

    return run


SUMS = ["n", "a", "aa", "p", "pp", "ap"]


def _summed(keys, columns, second):
    """The sums of the groups over the rows of a bucket of ``second``."""

    def run(rows, sides):
        squares = rows[second].is_null()
        rows, squares = rows.filter(pc.invert(squares)), rows.filter(squares)
        values, w = _numbers(rows, second), _numbers(rows, "w")
        out = []

        def add(source, at, column, sums):
            group = source.take(pa.array(at))
            out.append(pa.table({**{k: group[k] for k in keys}, "group_column": pa.array([column] * len(at), pa.string()),
                                 "group_value": group[column], **{s: sums.get(s, np.zeros(len(at))) for s in SUMS}}))

        for i, column in enumerate(columns):
            some = squares.filter(pc.is_valid(squares[column]))
            if some.num_rows:
                codes = _codes([[some[c]] for c in [*keys, column]])
                found, at = _firsts(codes)
                add(some, at, column, {"aa": np.bincount(codes, _numbers(some, f"a{i}"))[found]})
            if rows.num_rows:
                codes, p, inside = _ranks(rows, sides, keys, column, values, w)
                found, at = _firsts(codes[inside])
                c, p, u, a = codes[inside], p[inside], w[inside], _numbers(rows, f"a{i}")[inside]
                total = {"n": u, "a": a, "p": u * p, "pp": u * p * p, "ap": a * p}
                add(rows, np.flatnonzero(inside)[at], column, {s: np.bincount(c, x)[found] if len(c) else np.empty(0) for s, x in total.items()})
        return pa.concat_tables(out) if out else None

    return run


def paired_rank_sums(df, keys, columns, first, second, weight):
    """Per ``keys``, ``group_column`` and ``group_value``: rows ``n`` and sums of the ranks ``a`` of ``first`` and ``p`` of
    ``second`` (average ranks in the group) and of their squares and products ``aa``, ``pp`` and ``ap``.

    ``df`` is a stored table whose int ``columns`` give a row's groups, NULL for none, and whose doubles ``first`` and
    ``second`` are known; a row stands for ``weight`` rows.
    """
    keys, columns = list(keys), list(columns)
    by = [*keys, "group_column", "group_value"]
    df = df.select(*keys, *columns, weight, *[(F.col(c) + 0.0).alias(c) for c in (first, second)])
    count = df.count()
    buckets = max(2, -(-count // ROWS))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 2)

    def dealt(rows, value):
        splits, alone = _splits(df, value, buckets)
        kept = [*keys, "_bucket", "_alone", weight]
        long = _placed(df, value, splits, alone).select(*kept, *columns).unpivot(
            kept, columns, "group_column", "group_value").where("group_value is not null")
        left = _placed(rows, value, splits, alone).repartition(tasks, "_bucket", "_part").groupBy("_bucket", "_part")
        return left.cogroup(_below(long, by, weight).groupBy("_bucket", "_part"))

    def schema(*names):
        return [f for n in names for f in df.schema.fields if f.name == n]

    double = lambda names: [T.StructField(n, T.DoubleType()) for n in names]
    whole = T.StructType([*schema(*keys, *columns, second), *double(["w", *[f"a{i}" for i in range(len(columns))]])])
    ranked = dealt(df, first).applyInArrow(_guarded(_ranked(keys, columns, first, second, weight), whole), whole)
    sums = T.StructType([*schema(*keys), T.StructField("group_column", T.StringType()), T.StructField("group_value", T.IntegerType()), *double(SUMS)])
    summed = dealt(ranked, second).applyInArrow(_guarded(_summed(keys, columns, second), sums), sums)
    return summed.groupBy(*by).agg(*[F.sum(s).alias(s) for s in SUMS])


def _guarded(run, schema):
    """``run`` with columns in the order and types of ``schema``; a bucket without rows gives none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def guarded(rows, sides):
        wanted = to_arrow_schema(schema)
        if not rows.num_rows:
            return wanted.empty_table()
        out = run(rows, sides)
        return wanted.empty_table() if out is None else out.select(wanted.names).cast(wanted)

    return guarded
