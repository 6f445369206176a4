"""What five document filters remove, alone and together, in every order.

A document's failures are rows (id, bit): one branch carries the bits that a text decides by itself, the other comes from
an existential self-join that marks later copies. Their union is aggregated by id to one combination of bits per
document, and the combinations are counted per part. All orders of the filters are then read off the counts, of which a
part has at most 32.
"""

from itertools import permutations

from pyspark.sql import functions as F

from ..functions.skew import join_heavy
from ..functions.storage import cut
from .common import WORD, shuffle_partitions

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
SMALL = 200_000


def text_failures(text):
    """Bits of the filters that look at one text: A few words, B repeated words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bit(name, failed):
        return F.when(failed, 1 << FILTERS.index(name)).otherwise(0)

    return [words.alias("_words"), bit("C", capitals * 100 > F.char_length(text) * 2).alias("_c"),
            bit("D", text.rlike(r"[#$%&*|]")).alias("_d")], lambda: (
        bit("A", F.size("_words") < MIN_WORDS) + bit("B", F.size(F.array_distinct("_words")) * 100 < F.size("_words") * 50)
        + F.col("_c") + F.col("_d"))


def later_copies(docs, facts):
    """(doc_id, part, hash) of every row whose text also stands in a row of smaller id.

    ``docs`` holds doc_id, part, text and hash, ``facts`` the same without the text. Only texts whose hash occurs more than
    once are moved. Their least ids are found with a map-side aggregate per exact text; the left-semi join then asks for
    an equal hash, an equal text and a smaller id. Rows of a text with many copies are dealt over salts, and its one row on
    the other side is repeated for each of them, so no task holds a large group.
    """
    spark = docs.sparkSession
    repeated = cut(facts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    size = repeated.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size.groups <= SMALL:
        found = docs.join(F.broadcast(repeated), "hash")
    else:
        found = join_heavy(docs, repeated, "hash", "n").where("n is not null")
    piece = max(size.rows // (4 * shuffle_partitions(spark)), 1)
    salts = F.ceil(F.col("n") / piece).cast("int")
    found = cut(found.withColumn("salts", salts))
    least = found.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least")).select(
        F.col("hash").alias("_hash"), F.col("text").alias("_text"), "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    match = (F.col("hash") == F.col("_hash")) & (F.col("salt") == F.col("_salt")) & (F.col("text") == F.col("_text")) & (
        F.col("least") < F.col("doc_id"))
    return dealt.join(least, match, "left_semi").select("doc_id", "part", "hash")


def combinations(docs, labels):
    """Documents per part and combination of failed filters: (part, mask, docs, good, toxic).

    NULL texts count as empty, NULL sources as the part "". A row without an id is never a copy and has no label. Repeated rows
    count each; rows of one id are copies of rows with smaller ids only. An id labelled twice is good or toxic if any
    of its labels says so. Other columns play no part.
    """
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    first, bits = text_failures(F.col("text"))
    facts = cut(docs.select("doc_id", "part", "hash", *first).select("doc_id", "part", "hash", bits().alias("bits")))
    copies = later_copies(docs, facts)
    failures = facts.select("doc_id", "part", "hash", "bits", F.lit(1).alias("n")).unionByName(
        copies.select("doc_id", "part", "hash", F.lit(1 << COPY).alias("bits"), F.lit(0).alias("n")))
    found = failures.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # rows without an id match nothing and are spread by their hash
    found = found.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("hash")).otherwise(F.lit(0)))
    known = known.withColumn("spread", F.lit(0).cast("long"))

    def of(label):
        return F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias(label)

    return (found.join(known, ["doc_id", "spread"], "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("docs"), of("good"), of("toxic")))


def effects(spark):
    """What each step of each order does to each combination: a fixed table of 120 * 5 * 32 rows."""
    rows = []
    for order in ORDERS:
        earlier = 0
        for step, name in enumerate(order, start=1):
            bit = 1 << FILTERS.index(name)
            for mask in range(1 << len(FILTERS)):
                here, gone = bool(mask & bit), bool(mask & earlier)
                first_in = len(ORDERS) // mask.bit_count() if here else 0
                rows.append((order, step, mask, int(not here and not gone), int(here and not gone), int(here and gone),
                             int(mask == bit), first_in))
            earlier |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, kept int, removed int, redundant int, unique_fails int, shapley int")


def audit(docs, labels):
    """One row per part, order and step; see ``combinations`` for the cases. No documents give no rows."""
    counts = combinations(docs, labels)
    both = counts.join(F.broadcast(effects(docs.sparkSession)), "mask")

    def total(flag, of="docs"):
        return F.sum(F.col(flag) * F.col(of))

    return both.groupBy("part", "filter_order", "step").agg(
        *[total(c).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("shapley").alias("shapley"))
