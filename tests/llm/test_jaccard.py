import random
import re

import numpy as np
import pytest

from tapeloom.llm import jaccard, textmath

from .conftest import PASSAGE, frame, prose

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = SPLIT.findall((text or "").encode().translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), len(s), str(least.get(find(i), k) if s else k)) for i, ((k, _, _, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.classes(jaccard.jaccard_join(df)).collect())


def test_classes_equal_brute_force(docs, rows):
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_passages_and_families(spark, monkeypatch, seed):
    """Small limits, so that hot tokens, long prefixes, leaders and the step across classes all happen."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rng = random.Random(seed)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = prose(rng, 1)
        texts.append(" ".join(near))
    texts += [PASSAGE + " " + prose(rng, rng.randrange(0, 12)) for _ in range(40)]
    texts += [prose(rng, 30) + " " + PASSAGE for _ in range(20)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for hot in (3, 1000):
        monkeypatch.setattr(jaccard, "HOT", hot)
        hidden = jaccard.hot_tokens
        monkeypatch.setattr(jaccard, "hot_tokens", lambda d, t, w, least=hot: hidden(d, t, w, least))
        assert found(frame(spark, rows)) == brute(rows)
        monkeypatch.setattr(jaccard, "hot_tokens", hidden)


def test_empty(nothing):
    assert found(nothing) == []


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (7, 7)], "a long, b long")
    out = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert {out[i] for i in range(51)} == {0} and out[99] == out[100] == 99


def test_shingle_sets_tell_texts_apart():
    data = [b"a b c d e f", b"A B\tC d e\nf", b"a b c d e", b"a b", b"ab", b"b a", b"", b"a b c d e f a b c d e f"]
    sets = textmath.shingle_sets(data)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 1, 0, 6]
    assert np.array_equal(sets[0], sets[1]) and sets[2][0] in sets[0]
    assert len({int(s[0]) for s in sets[2:6]}) == 4
