"""Mixing sources to target weights along a curriculum whose weights change with training time."""

from pyspark.sql import functions as F

from .common import pack, unpack, with_running

BROADCAST_SOURCES = 100_000


def source_targets(sizes, weights=(5, 2, 1), cap=3):
    """One row per source with ``target``: its share of all words, by ``weights`` repeating over the sources in order.

    ``sizes`` holds ``source`` and ``source_size``. A target stops at ``cap`` times the source's size and the excess is
    shared again by weight until none is above. Each round is one aggregate over the sources and brings three numbers
    to the driver; a round that caps no further source is the last. NULL is a source of its own, the last one. Sources
    without words get 0.
    """
    ranked, _ = with_running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap))
    total, share, known = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        full = F.col("limit") <= F.lit(share) * F.col("weight")
        held, open_weight, count = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if count == known or not open_weight:
            break
        share, known = (total - held) / open_weight, count
    return ranked.withColumn("target", F.least("limit", F.lit(share) * F.col("weight")))


def mix(docs, size, source="source", tie=("doc_id",), weights=(5, 2, 1), cap=3, slopes=(-0.5, 0.0, 0.5), seed=""):
    """Decide what the mix takes of every document, and when.

    ``size``: column with the words of a document. Each source is one stream of its documents in pseudo-random order
    (MD5 of ``seed`` and the first ``tie`` column, then ``tie``), read again from the start when it ends. The mix takes the
    first ``floor(target)`` words of that stream; the copy in which the demand ends is cut there, so every source meets
    its target to the word and no document is taken more than ``cap`` times.

    A source's weight over training time t in [0, 1] is its share times ``1 + slope * (2t - 1)``; ``slopes`` repeats over the
    sources like ``weights``. Its integral, the cumulative demand, is inverted at the middle of each copy to give the
    copy's time.

    Adds ``source_size``, ``target``, ``taken`` and ``copies``, an array of (copy, words, time). NULL sizes count 0; documents
    of size 0 and rows of an unused tail have no copies. NULL in ``tie`` sorts last; rows equal in ``tie`` follow each other
    in any order. No rows give no rows. Columns of the input with the added names are replaced.
    """
    rows = pack(docs).withColumns({"source": F.col("row")[source], "size": F.coalesce(F.col("row")[size], F.lit(0)).cast("long")})
    keys = {f"tie{i}": F.col("row")[t] for i, t in enumerate(tie)}
    rows = rows.withColumns(keys).withColumn(
        "shuffled", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("tie0").cast("string"), F.lit(""))).cast("binary")))
    order = [F.col("source").asc_nulls_last(), F.col("shuffled"), *[F.col(k).asc_nulls_last() for k in keys]]
    placed, _ = with_running(rows, order, "size", "before")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("source_start"))
    targets = source_targets(sizes, weights, cap).select(
        F.col("source").alias("of"), "source_size", "source_start", "target",
        F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("nth") % len(slopes) + 1).cast("int")).alias("slope"))
    if sizes.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    mixed = placed.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    mixed = mixed.withColumn("offset", F.col("before") - F.col("source_start"))
    mixed = mixed.withColumn("demand", F.floor("target").cast("long"))

    def one(epoch):
        start = F.col("offset") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("demand") - start))
        middle, slope = (start + words / 2.0) / F.nullif(F.col("demand"), F.lit(0)), F.col("slope")
        root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * middle)
        time = F.when(slope == 0, middle).otherwise((root - (1 - slope)) / F.nullif(2 * slope, F.lit(0.0)))
        return F.when(words > 0, F.struct(F.lit(epoch).alias("copy"), words.alias("words"), time.alias("time")))

    mixed = mixed.withColumn("copies", F.filter(F.array(*[one(e) for e in range(cap)]), lambda c: c.isNotNull()))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return unpack(mixed, source_size=F.col("source_size"), target=F.col("target"), taken=taken, copies=F.col("copies"))


def training_order(mixed, tie=("doc_id",)):
    """One row per copy of a mixed table, range-sorted by its time, with ``copy``, ``words``, ``time`` and ``position`` from 0."""
    rows = mixed.select(F.struct(*[c for c in mixed.columns if c != "copies"]).alias("row"), F.explode("copies").alias("c"))
    rows = rows.select("row", "c.*", *[F.col("row")[t].alias(f"tie{i}") for i, t in enumerate(tie)], F.lit(1).cast("long").alias("one"))
    order = [F.col("time"), *[F.col(f"tie{i}").asc_nulls_last() for i in range(len(tie))], F.col("copy")]
    placed, _ = with_running(rows, order, "one", "position")
    return unpack(placed, copy=F.col("copy"), words=F.col("words"), time=F.col("time"), position=F.col("position"))
