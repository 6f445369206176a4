"""Rows go to Python in batches that are small in bytes, whatever their width."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import jaccard, token_file, toxicity
from tapeloom.llm.common import ARROW_BYTES
from tapeloom.llm.queries import tokenizer_path


def most_bytes(docs):
    def largest(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [sum(len(t) for t in batch["text"])]})

    return docs.mapInPandas(largest, "n long").agg(F.max("n")).first()[0]


@pytest.fixture
def plain(spark):
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.unset(ARROW_BYTES)
    yield spark
    spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


@pytest.mark.parametrize("operator", ["jaccard", "toxicity", "tokens"])
def test_wide_rows_go_to_python_in_small_batches(plain, operator):
    labels = plain.createDataFrame([], "doc_id long, toxic int")
    docs = plain.range(300).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" word")).alias("text"))
    run = {"jaccard": lambda: jaccard.jaccard_join(docs), "toxicity": lambda: toxicity.train(docs, labels),
           "tokens": lambda: token_file.write_token_files(docs, tokenizer_path())}[operator]
    wide = plain.range(300, numPartitions=1).select(F.repeat(F.lit("word "), 20_000).alias("text"))  # 30 MB
    assert most_bytes(wide) == 30_000_000
    run()
    assert most_bytes(wide) <= (4 << 20) + 200_000


def test_a_setting_of_the_session_holds(plain):
    plain.conf.set(ARROW_BYTES, "1m")
    docs = plain.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r.root is not None for r in jaccard.jaccard_join(docs).collect()} == {True}
    assert plain.conf.get(ARROW_BYTES) == "1m"
