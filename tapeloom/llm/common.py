"""Helpers the operators share: rows packed against name clashes, global running sums, byte sizes."""

from pyspark.sql import Window, functions as F

from ..functions.storage import cut

# The white space that separates words, as an RE2 and Java character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def pack(df):
    """One column ``row`` that holds every column, so columns added later cannot clash with names of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpack(df, **added):
    """The fields of ``row`` and the ``added`` columns; an added column replaces a field of the same name."""
    taken = {name.lower() for name in added}
    fields = [f for f in df.schema["row"].dataType.names if f.lower() not in taken]
    return df.select(*[F.col("row")[f].alias(f) for f in fields], *[c.alias(name) for name, c in added.items()])


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running(df, order, value, name):
    """Add ``name``: the sum of ``value`` over all rows before this one in ``order``. Returns the frame and the total.

    Rows are dealt out by ranges of ``order``, which must end in columns that tell rows apart: then no range holds a
    hot key whole, and the only window that spans ranges has one row per range. The placed rows are stored, so a task
    that runs again finds the same ranges.
    """
    placed = cut(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
                 .withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start"))
    return out.drop("_range", "_start"), total


def small_batches(spark, most="4m"):
    """Let Spark hand rows to Python in batches of about ``most`` bytes instead of 64 MB; a session's own setting holds.

    A task holds a batch several times over: off the heap, as an Arrow table and as Python objects.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, most)


def utf8_size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text):
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))), F.lit(0)).cast("long")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df, rows=200_000):
    """Store a narrow frame; hint a broadcast only if it has at most ``rows`` rows, else leave the join to a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df
