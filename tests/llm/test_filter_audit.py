from collections import Counter
from itertools import permutations
import re

import pytest

from tapeloom.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, part string"
WORD = re.compile(r"[^ \t-\r]+")


def brute(rows, labels):
    """Every order applied to every document, one after the other."""
    rows = [(i, t or "", s or "") for i, t, _, s in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x, _ in labels if i is not None and x == 1}
    failed = []
    for i, t, _ in rows:
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and t in least and least[t] < i}
        failed.append({k for k, v in fails.items() if v})
    out = {}
    for part in {s for _, _, s in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for step, name in enumerate(order, start=1):
                c = Counter()
                for n, ((i, _, s), f) in enumerate(zip(rows, failed)):
                    if s != part:
                        continue
                    if f == {name}:
                        c["unique"] += 1
                    if n in gone:
                        c["redundant"] += name in f
                    elif name in f:
                        gone.add(n)
                        c["removed"] += 1
                        c["good"] += i in good
                        c["toxic"] += i in toxic
                        shapley[name] += 1
                    else:
                        c["kept"] += 1
                out[part, "".join(order), step] = [c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def result(docs, labels):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in filter_audit.audit(docs, labels).collect()}


def test_audit_equals_brute_force(spark, docs, rows):
    labels = [(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 0, 0, "x"), (100, 1, 1, "x"), (101, 1, None, "x"), (404, None, 1, "x"), (None, 1, 1, "x"), (99_999, 1, 1, "x")]
    got = result(docs, spark.createDataFrame(labels, LABELS))
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert got == brute(rows, labels)


def test_no_documents_and_no_labels(spark, docs, nothing, rows):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(nothing, none).count() == 0
    assert result(docs, none) == brute(rows, [])


@pytest.mark.parametrize("small", [filter_audit.SMALL, 0])
def test_a_large_group_of_copies_is_dealt_over_salts(spark, monkeypatch, small):
    monkeypatch.setattr(filter_audit, "SMALL", small)
    rows = [(i, "same text", "en", "s") for i in range(3000)] + [(None, "same text", "en", "s")] * 50
    rows += [(10_000 + i, f"pair {i // 2}", "en", None) for i in range(300)] + [(2, "same text", "en", "s"), (2, "other", "en", "s"), (0, "same text", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = {(r.part, r.mask): r.docs for r in filter_audit.combinations(docs, spark.createDataFrame([], LABELS)).collect()}
    few, copy = 1, 17  # all are short
    assert counts == {("s", few): 1 + 50 + 1, ("s", copy): 2999 + 1, ("t", few): 1, ("", few): 150, ("", copy): 150}


def test_equal_hashes_of_different_texts_are_told_apart(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "b", "x"), (4, "a", "x"), (5, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").selectExpr("*", "bigint(7) as hash")
    assert sorted(r.doc_id for r in filter_audit.later_copies(docs, docs.drop("text")).collect()) == [3, 4]
