"""Joins and ranks that stay balanced when one key or one value holds a large share of the rows."""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window, functions as F

from .storage import cut


def join_heavy(left, right, on, weight, heavy=1000, hot_rows=1_000_000):
    """Left join to ``right`` (one row per key), safe for hot and for missing keys.

    ``weight`` tells how many rows of ``left`` a key stands for. If some key exceeds ``hot_rows``, the ``heavy`` keys
    with the largest weight are broadcast, a table of at most ``heavy`` rows; every other key then holds at most
    ``1 / heavy`` of the rows and goes through the shuffle join. Rows the broadcast answered, and rows without a key,
    are spread by a hash of the row, so no task gets them all.
    """
    on = [on] if isinstance(on, str) else list(on)
    values = [c for c in right.columns if c not in on]
    hot = (right.agg(F.max(weight)).first()[0] or 0) > hot_rows
    done = F.lit(False)
    for c in on:
        done = done | F.col(c).isNull()
    out = left
    if hot:
        top = right.orderBy(F.desc(weight), *on).limit(heavy)
        top = top.select(*[F.col(c).alias(f"_h_{c}") for c in right.columns], F.lit(True).alias("_h_hit"))
        out = left.join(F.broadcast(top), [F.col(c) == F.col(f"_h_{c}") for c in on], "left")
        done = done | F.col("_h_hit").isNotNull()
    anywhere = F.pmod(F.xxhash64(*left.columns), F.lit(1 << 30)) + 1
    out = out.withColumn("_spread", F.when(done, anywhere).otherwise(F.lit(0).cast("long")))
    rest = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns], F.lit(0).cast("long").alias("_r_spread"))
    match = [F.col(c) == F.col(f"_r_{c}") for c in on] + [F.col("_spread") == F.col("_r_spread")]
    out = out.join(rest, match, "left")

    def value(c):
        found = F.col(f"_r_{c}")
        return (F.when(F.col("_h_hit").isNotNull(), F.col(f"_h_{c}")).otherwise(found) if hot else found).alias(c)

    return out.select(*[F.col(c) for c in left.columns], *[value(c) for c in values])


def with_value_bucket(df, value, buckets=256, sample=None):
    """Add ``_bucket``: the place of each row's value among approximate quantiles of ``value``.

    The bucket depends on the value alone, so equal values meet and results do not change if a task is run again.
    Quantiles are taken over the whole of ``sample`` (default: ``df``): no (key, bucket) pair can outgrow an even share.
    Only the ``buckets - 1`` quantiles come to the driver. ``value`` must not hold NULLs in ``df``.
    """
    points = [i / buckets for i in range(1, buckets)]
    source = df if sample is None else sample
    found = source.agg(F.percentile_approx(F.col(value).cast("double"), points, 4 * buckets)).first()[0] or []
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    if len(splits) == 2:
        return df.withColumn("_bucket", F.lit(0))
    place = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket")
    return place.transform(df).withColumn("_bucket", F.col("_bucket").cast("int"))


def running_offsets(df, keys, bucket, total, name):
    """Per (keys, bucket): sum of ``total`` over the buckets before it. The window holds one row per bucket."""
    order = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (df.groupBy(*keys, bucket).agg(F.sum(total).alias("_sum"))
            .select(*keys, bucket, F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias(name)))


def average_ranks(df, keys, value, name, weight=None, buckets=256, sample=None):
    """One row per (keys, value): its average rank ``name`` and its row count ``<name>_n``.

    ``weight`` names a column that says how many rows each row stands for. Ties are counted before any sort. A window
    sorts one value bucket, never a whole key.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    counted = cut(with_value_bucket(counted, value, buckets, sample))  # read twice
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    local = counted.withColumn("_below", F.sum("_n").over(inside) - F.col("_n"))
    ranked = local.join(running_offsets(counted, keys, "_bucket", "_n", "_off"), [*keys, "_bucket"])
    rank = F.col("_off") + F.col("_below") + (F.col("_n") + 1) / 2.0
    return ranked.select(*keys, value, rank.alias(name), F.col("_n").alias(f"{name}_n"))
