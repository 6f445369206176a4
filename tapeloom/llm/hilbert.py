"""Sharding along a Hilbert curve: files that follow each other in several metadata dimensions at once."""

from pyspark.sql import functions as F

from .common import pack, shuffle_partitions, unpack, with_running


def depth_cuts(df, column, bits):
    """Lower bounds of the equal-depth levels of ``column``: at most ``2 ** bits`` rows (level, low), NULL as the top value.

    The level of a value is ``rows with a smaller value * 2 ** bits // all rows``, exact over the whole table. Only
    distinct values are ordered, and only one row per level comes to the driver.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    before, total = with_running(counts, [F.col("v").asc_nulls_last()], "n", "before")
    level = F.expr(f"int(before * {1 << bits} div {max(total, 1)})")
    lows = before.groupBy(level.alias("level"), F.col("v").isNull().alias("missing")).agg(F.min("v").alias("low")).collect()
    return [(r.level, r.low) for r in sorted(lows, key=lambda r: (r.missing, r.level))]


def level_of(value, cuts):
    """Level of each value under ``cuts`` of ``depth_cuts``."""
    found = F.lit(0)
    for level, low in cuts:
        at = value.isNull() if low is None else value >= F.lit(low)
        found = F.when(at, F.lit(level)).otherwise(found)
    return found


def with_hilbert(df, axes, bits, name):
    """Add ``name``, the place on a Hilbert curve of the cell whose coordinates ``axes`` hold ``bits`` bits each.

    Each step is a projection of integer operations (the coordinate form of J. Skilling, 2004).
    """
    first = axes[0]
    for step in range(bits - 1, 0, -1):
        q, low = 1 << step, (1 << step) - 1
        for axis in axes:
            up = F.col(axis).bitwiseAND(q) != 0
            mixed = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(low)
            turned = F.when(up, F.col(first).bitwiseXOR(F.lit(low))).otherwise(F.col(first).bitwiseXOR(mixed))
            if axis == first:
                df = df.withColumn(first, turned)
            else:
                swapped = F.when(up, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(mixed))
                df = df.withColumns({first: turned, axis: swapped})
    for left, axis in zip(axes, axes[1:]):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(left)))
    flip = F.lit(0)
    for step in range(bits - 1, 0, -1):
        flip = F.when(F.col(axes[-1]).bitwiseAND(1 << step) != 0, flip.bitwiseXOR(F.lit((1 << step) - 1))).otherwise(flip)
    df = df.withColumn("_flip", flip)
    place = F.lit(0)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            digit = F.shiftright(F.col(axis).bitwiseXOR(F.col("_flip")), bit).bitwiseAND(1)
            place = F.shiftleft(place, 1).bitwiseOR(digit)
    return df.withColumn(name, place).drop("_flip")


def hilbert_shards(df, dims, tie, shards=8, bits=4):
    """Add ``curve``, ``shard`` and ``slot`` to every row: rows ordered along the curve and cut into even runs.

    ``dims``: columns to quantise into ``2 ** bits`` levels of equal depth each. ``tie``: columns that order rows of one
    cell; they should tell rows apart, then a hot cell (one source with a third of the rows) is split over many tasks.
    Shard sizes in rows differ by at most one. ``slot`` counts from 0 without gaps inside a shard.

    NULL in a dimension counts as its largest value, NULL in ``tie`` sorts last. Rows equal in ``dims`` and ``tie`` get
    neighbouring places in any order. No rows give no rows; with fewer rows than shards some shards stay empty. Input
    columns named ``curve``, ``shard`` or ``slot`` are replaced, all others are kept.
    """
    axes = [f"axis{i}" for i in range(len(dims))]
    order = [f"tie{i}" for i in range(len(tie))]
    levels = {a: level_of(F.col("row")[d], depth_cuts(df, d, bits)) for a, d in zip(axes, dims)}
    rows = with_hilbert(pack(df).withColumns(levels), axes, bits, "curve").drop(*axes)
    rows = rows.withColumns({o: F.col("row")[t] for o, t in zip(order, tie)}).withColumn("one", F.lit(1).cast("long"))
    ranked, total = with_running(rows, [F.col("curve"), *[F.col(o).asc_nulls_last() for o in order]], "one", "place")
    total = max(total, 1)
    ranked = ranked.withColumn("shard", F.expr(f"int(place * {shards} div {total})"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return unpack(ranked, curve=F.col("curve"), shard=F.col("shard"), slot=F.col("place") - first)


def write_shards(sharded, path):
    """Write one Parquet folder per shard, rows in slot order, so the files' minima and maxima prune by every dimension."""
    spark = sharded.sparkSession
    placed = sharded.repartitionByRange(shuffle_partitions(spark), "shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)
