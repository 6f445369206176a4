"""A corpus made ready for training, stage by stage; each stage reads what the one before it wrote.

1. ``toxicity``: documents that the positive-unlabelled classifier scores 0.5 or more go.
2. ``near_duplicates``: of every class of the n-gram Jaccard join the document with the smallest id stays.
3. ``decontamination``: documents that hold a window of a benchmark item go.
4. ``mixing``: sources are brought to their target weights; documents repeat or go, always whole.
5. ``token_files``: the texts become token ids in binary files, which are read back.

All stages but the last return the columns of ``documents``.
"""

from pyspark.sql import Window, functions as F

from tapeloom.functions.storage import cut
from tapeloom.llm import decontaminate, jaccard, mixing, token_file, toxicity
from tapeloom.llm.common import broadcast_if_small, pack, shuffle_partitions, table, unpack, word_count
from tapeloom.llm.files import shared_folder
from tapeloom.llm.queries import tokenizer_path

# The classifier, the shingle join and the token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def remove_toxic(spark, docs, sf_dir):
    """Documents scored below 0.5 by the classifier trained on ``docs`` and ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(F.col("text"), model) < 0.5)


def remove_near_duplicates(spark, docs, sf_dir):
    """One document of each class of the join: the smallest id (NULL last), of one id the smallest text hash, once.

    Documents without words are no one's duplicate and all stay.
    """
    joined = jaccard.jaccard_join(docs)
    nodes = joined.where("root is not null").groupBy("root", "doc_id", "text_hash").agg(F.lit(1).alias("one"))
    some = nodes.groupBy("root").agg(F.min("doc_id").alias("least"))
    first = nodes.join(some, "root").where("doc_id <=> least").groupBy("root", "least").agg(F.min("text_hash").alias("text_hash"))
    losers = broadcast_if_small(nodes.join(first.select(F.col("root").alias("_r"), F.col("least").alias("_id"), F.col("text_hash").alias("_h")),
                            (F.col("root") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")),
                            "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")))
    kept = unpack(_keyed(docs, losers, "left_anti"))
    again = joined.where("root is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    return _once(kept, cut(again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))))


def _keyed(docs, other, how):
    """Packed documents joined to rows of (_id, _h) by id and text hash."""
    match = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_h"))
    return pack(docs).join(other, match, how)


def _once(docs, repeated):
    """Of rows that repeat id and text, one."""
    if repeated.isEmpty():
        return docs
    single = unpack(_keyed(docs, repeated, "left_semi")).dropDuplicates(["doc_id", "text"])
    return unpack(_keyed(docs, repeated, "left_anti")).unionByName(single)


def remove_contaminated(spark, docs, sf_dir):
    """Documents without a word inside an occurrence of a benchmark window."""
    report = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.remove_documents(docs, report)


def mix_sources(spark, docs, sf_dir):
    """The mix in training order: a document stands there once per copy, whole.

    The copy in which a source's demand ends is taken if at least half of its words are wanted, else left out.
    """
    narrow = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix(narrow, "size", tie=("doc_id", "text_hash"))
    copies = mixed.groupBy("doc_id", "source", "text_hash", "size").agg(
        F.flatten(F.collect_list("copies")).alias("copies"), F.count("*").alias("rows")).where("size(copies) > 0")
    copies = cut(copies).select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), "size", "copies", "rows")
    found = _keyed(docs, copies, "inner").where(F.col("row.source").eqNullSafe(F.col("_s")))
    if not copies.where("rows > 1").isEmpty():  # repeated rows share their copies
        nth = F.row_number().over(Window.partitionBy("_id", "_s", "_h").orderBy(F.lit(1)))
        found = found.withColumn("nth", nth).withColumn("copies", F.expr("filter(copies, (c, i) -> i % rows = nth - 1)"))
    taken = found.select("row", "size", F.explode("copies").alias("c")).where(F.col("c.words") * 2 >= F.col("size"))
    order = ["c.time", "row.doc_id", "c.copy"]
    placed = taken.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return unpack(placed).select(*docs.columns)


def write_tokens(spark, docs, sf_dir):
    """Place, length and checksum of every document in the token files."""
    return token_file.checksums(*token_file.write_token_files(docs, tokenizer_path()))


STAGES = [("toxicity", remove_toxic), ("near_duplicates", remove_near_duplicates), ("decontamination", remove_contaminated),
          ("mixing", mix_sources), ("token_files", write_tokens)]


def run(spark, sf_dir):
    """Apply the stages to the documents of ``sf_dir``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
