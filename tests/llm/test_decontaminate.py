import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from tapeloom.llm import decontaminate as d

from .conftest import PASSAGE

ITEMS = [(1, PASSAGE), (2, "ONE"), (3, "one two"), (4, None), (5, "..."), (None, "été 数据"), (1, PASSAGE[:60]), (7, " ".join(PASSAGE.split()[:9]))]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        x = words(t)
        n = min(len(x), 10)
        for i in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == x[i:i + n]:
                    hit.update(range(p, p + n))
                    items.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(items)


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_report_equals_brute_force(spark, docs, rows):
    out = d.contamination(docs, benchmark(spark)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in out)
    assert got == sorted((str(i), *brute(t)) for i, t, _, _ in rows)


def test_without_the_anchor_set(spark, docs, monkeypatch):
    some = docs.where("doc_id between 300 and 406")
    key = lambda df: sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in df.collect())
    small = key(d.contamination(some, benchmark(spark)))
    monkeypatch.setattr(d, "SET_ANCHORS", 0)
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert key(d.contamination(some, benchmark(spark))) == small


def test_documents_and_spans_go(spark, docs, nothing):
    items = benchmark(spark, [(1, PASSAGE)])
    report = d.contamination(docs, items)
    kept = d.remove_documents(docs, report)
    assert kept.columns == docs.columns and docs.count() - kept.count() == 11
    clean = d.remove_spans(docs, report)
    assert clean.count() == docs.count()
    text = clean.where("doc_id = 300").first().text
    assert "wizards" not in text and len(words(text)) == 30
    assert d.contamination(clean, items).where("n_hit > 0").count() == 0
    assert d.contamination(nothing, items).count() == 0
    assert d.contamination(docs, benchmark(spark, [])).agg(F.sum("n_hit")).first()[0] == 0
