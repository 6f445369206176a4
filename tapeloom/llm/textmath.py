"""Words and shingles of many texts as numpy arrays, without a Python object per word."""

import numpy as np

# White space that separates words; constants of the 64-bit finaliser (splitmix64).
SPACES = b" \t\n\x0b\x0c\r"
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_powers = {"n": 0}


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _power_tables(n):
    """Powers of the base and of its inverse modulo 2 ** 64, at least ``n``."""
    if _powers["n"] < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def chunks(texts, size=CHUNK):
    """Lists of (first index, encoded texts) with about ``size`` bytes each; a longer text is a chunk of its own."""
    held, first, total = [], 0, 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "replace")
        if held and total + len(data) > size:
            yield first, held
            held, first, total = [], i, 0
        held.append(data)
        total += len(data) + 1
    if held:
        yield first, held


def words(data, is_word=NOT_SPACE, fold=True):
    """``(buffer, starts, ends, doc)`` of all words in a list of byte strings."""
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = is_word[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    doc = np.searchsorted(np.cumsum(lengths), starts, "right")
    return LOWER[raw] if fold else raw, starts, ends, doc


def word_hashes(buffer, starts, ends):
    """64-bit hash of each word from running sums of a polynomial in the bytes."""
    up, down = _power_tables(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:len(buffer)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct(values):
    """The sorted distinct values of an array; on short arrays a plain sort is several times faster than ``np.unique``."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    new = values[1:] != values[:-1]
    return values if new.all() else values[np.concatenate(([True], new))]


def shingle_sets(data, width=5):
    """For each text: sorted distinct 64-bit hashes of its ``width``-word shingles; fewer words are one shingle."""
    buffer, starts, ends, doc = words(data)
    hashes = word_hashes(buffer, starts, ends)
    counts = np.bincount(doc, minlength=len(data))
    first = np.concatenate(([0], np.cumsum(counts)))
    salts = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(BASE))
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += mix(hashes[k:len(hashes) - width + 1 + k] ^ salts[k]) if len(rolled) else rolled
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= width:
            out.append(distinct(rolled[a:b - width + 1]))
        elif n:
            parts = mix(hashes[a:b] ^ salts[:n]).sum(dtype=np.uint64)
            out.append(mix(np.array([parts + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
