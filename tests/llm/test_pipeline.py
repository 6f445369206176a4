from collections import Counter
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tapeloom.llm import jaccard, mixing, toxicity
from tapeloom.llm.common import word_count
from tapeloom.llm.queries import tokenizer_path

from .conftest import PASSAGE, frame, prose
from .test_decontaminate import words
from .test_filter_audit import WORD
from .test_jaccard import brute
from .test_models import corpus


@pytest.fixture(scope="module")
def inputs(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs, labels = corpus(spark, n=300)
    place = {r: n for n, r in enumerate(rows)}  # rows that repeat keep one id, all others have their own
    docs = docs.unionByName(frame(spark, [(1000 + place[r], *r[1:]) for r in rows]))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def key(r):
    return r.doc_id, r.text, r.lang, r.source


def test_stages_one_by_one(spark, inputs):
    docs, kept = spark.read.parquet(f"{inputs}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, inputs).cache()
        before, after = docs.collect(), out.collect()
        if name != "token_files":
            assert out.columns == columns, name
        if name == "toxicity":
            scores = docs.select("doc_id", toxicity.toxicity(docs["text"], toxicity.train(docs, spark.read.parquet(f"{inputs}/labels.parquet"))).alias("s")).collect()
            assert len(after) == sum(r.s < 0.5 for r in scores) < len(before)
        elif name == "near_duplicates":
            classes = Counter(c for _, n, c in brute([key(r) for r in before]) if n)
            assert len([r for r in after if words(r.text) or (r.text or "").strip()]) == len(classes)
            assert all(n == 1 for n in Counter(c for _, n, c in brute([key(r) for r in after]) if n).values())
        elif name == "decontamination":
            assert Counter(map(key, after)) == Counter(key(r) for r in before if " ".join(words(PASSAGE)[:10]) not in " ".join(words(r.text))
                                                       and not any(" ".join(words(PASSAGE)[i:i + 10]) in " ".join(words(r.text)) for i in range(9)))
        elif name == "mixing":
            whole = {(r.doc_id, r.source): r.text for r in before}
            assert all(whole[r.doc_id, r.source] == r.text for r in after)
            mixed = mixing.mix(docs.withColumn("words", word_count("text")), "words").select("source", "target", "source_size").distinct().collect()
            taken = Counter()
            for r in after:
                taken[r.source] += len(WORD.findall(r.text))
            longest = Counter()
            for r in before:
                longest[r.source] = max(longest[r.source], len(WORD.findall(r.text or "")))
            assert all(abs(taken[r.source] - r.target) <= longest[r.source] / 2 + 1 for r in mixed)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(tokenizer_path())
            want = Counter()
            for r in before:
                ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
                want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
            assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want
        docs = out
        kept.append(len(after))
    assert corpus_pipeline.run(spark, inputs).count() == kept[-1]


def test_stages_take_empty_tables(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, inputs).count() == 0


def test_repeated_rows_are_mixed_one_by_one(spark, inputs):
    docs = frame(spark, [(1, prose(__import__("random").Random(1), 30), "en", "a")] * 3 + [(2, "b c d", "en", "b"), (None, "e f", None, None)])
    out = corpus_pipeline.mix_sources(spark, docs, inputs).collect()
    assert abs(sum(len(r.text.split()) for r in out) - 95) <= 15 + 2 + 1
    assert jaccard.classes(jaccard.jaccard_join(docs)).count() == 5
