import random
import tracemalloc

import numpy as np
import pytest

from tapeloom.llm import jaccard, textmath, token_file
from tapeloom.llm.queries import tokenizer_path

from .conftest import frame, prose
from .test_jaccard import brute, found


def family(rng, size):
    """Texts with up to three changed words of one base: most link to some others, few to any one of them."""
    base, texts = prose(rng, 150).split(), []
    for i in range(size):
        near = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 4)):
            near[at] = f"new{i}"
        texts.append(" ".join(near))
    return [(i, t, None, None) for i, t in enumerate(texts)]


def compared(spark, monkeypatch, rows):
    """The classes, and the pairs whose whole sets were fetched."""
    pairs, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda some, *args: pairs.append(some.select("a", "b")) or verified(some, *args))
    out = found(frame(spark, rows))
    monkeypatch.setattr(jaccard, "_verified", verified)
    met = pairs[0]
    for more in pairs[1:]:
        met = met.union(more)
    return out, met.distinct().count()


def test_pairs_of_a_large_family_do_not_grow_with_its_square(spark, monkeypatch):
    """op5: a family was compared pair by pair wherever its members had not linked to one leader."""
    rows = family(random.Random(5), 300)
    out, pairs = compared(spark, monkeypatch, rows)
    assert out == brute(rows)
    assert pairs < 10 * len(rows), pairs


def test_sketches_never_hide_an_overlap():
    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 3000):
        x = textmath.distinct(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        y = textmath.distinct(np.concatenate((x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, size // 5 + 1, np.uint64))))
        bits = [np.unpackbits(jaccard.sketch(s).view(np.uint8)) for s in (x, y)]
        shared = len(np.intersect1d(x, y))
        assert len(x) - (bits[0] & ~bits[1] & 1).sum() >= shared <= len(y) - (bits[1] & ~bits[0] & 1).sum()
        assert bits[0].sum() <= size and len(bits[0]) == 1024


@pytest.mark.parametrize("values", [[], [3], [3, 3], [2, 1, 2, 9, 1]])
def test_distinct_equals_unique(values):
    values = np.array(values, np.uint64)
    assert textmath.distinct(values).tolist() == np.unique(values).tolist()


def test_words_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    """op2: beyond 100,000 words all of them were forgotten and encoded again."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26 ** k % 26] for k in range(4)) for i in range(130_000)]
    encoder = token_file.WordEncoder(tokenizer_path())
    seen, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda tokens: seen.append(len(tokens)) or learn(tokens))
    texts = [" ".join(words[a:a + 10_000]) for a in range(0, len(words), 10_000)]
    first = [encoder.encode([t])[0] for t in texts]
    again = [encoder.encode([t])[0] for t in texts]
    assert sum(seen) == len(words)
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
    assert np.array_equal(first[3], encoder.whole(texts[3]))


def test_known_words_find_what_was_added():
    rng, known, plain = np.random.default_rng(2), token_file.KnownWords(), {}
    for size in (0, 5, 400, 3, 3, 70, 20_000, 1):
        keys = np.setdiff1d(rng.integers(0, 1 << 62, size, np.uint64), np.fromiter(plain, np.uint64, len(plain)))
        sizes = rng.integers(-1, 6, len(keys))
        ids = rng.integers(0, 1 << 16, int(np.maximum(sizes, 0).sum())).astype(np.uint32)
        known.add(keys, sizes, ids)
        parts = np.split(ids, np.cumsum(np.maximum(sizes, 0)))
        plain.update((k, None if n < 0 else part.tolist()) for k, n, part in zip(keys.tolist(), sizes.tolist(), parts))
        wanted = np.sort(np.concatenate((np.fromiter(plain, np.uint64, len(plain)), np.array([1 << 63], np.uint64))))
        begins, lengths, found = known.find(wanted)
        got = {k: None if n < 0 else known.ids[b:b + n].tolist() for k, b, n, ok in zip(wanted.tolist(), begins.tolist(), lengths.tolist(), found) if ok}
        assert got == plain and len(known) == len(plain) and len(known.parts) < 12


def test_packing_takes_few_bytes_an_id():
    """pipeline: a file of token ids was packed and unpacked with 8-byte lengths."""
    ranks = np.arange(400_000, dtype=np.uint32) * np.uint32(7)
    tracemalloc.start()
    control, data = token_file.encode_ranks(ranks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * len(ranks), most / len(ranks)
    assert np.array_equal(token_file.decode_ranks(control, data, len(ranks)), ranks)


def test_tasks_of_a_job_share_known_words_and_jobs_do_not():
    encoder = token_file._encoder(tokenizer_path(), "job 1")
    encoder.encode(["one two"])
    assert token_file._encoder(tokenizer_path(), "job 1") is encoder and len(encoder.known) == 2
    assert len(token_file._encoder(tokenizer_path(), "job 2").known) == 0
