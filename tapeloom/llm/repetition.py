"""Repetition rules: the share of a text's characters inside repeated n-grams and repeated lines.

Word n-grams of all lengths come from one running sum of word hashes, so a window's hash is one subtraction and one
product. Documents of a batch are measured together in numpy, about a quarter of a megabyte at a time.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from .textmath import BASE, MIX_A, chunks, mix, word_hashes, words

# The published bounds on the share of characters in repeated n-grams, by n, and in repeated lines.
NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
SYMBOLS = b"#*$%&|<>"
BASE_NGRAM = 3
MIN_WORDS = 50
CHUNK = 1 << 18

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
COLUMNS = COUNTS + [f"chars_{n}" for n in NGRAM_SHARE]


def _groups(keys):
    """For every entry of ``keys``: whether its value occurs more than once, and whether it occurs earlier."""
    repeated, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) == 0:
        return repeated, later
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    held = keys[order]
    new[1:] = held[1:] != held[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(keys))
    repeated[order] = np.repeat(sizes > 1, sizes)
    later[:] = repeated
    later[np.minimum.reduceat(order, starts)] = False
    return repeated, later


def _powers(n):
    table = np.full(n, MIX_A, np.uint64)
    table[0] = 1
    up = np.multiply.accumulate(table)
    table[1:] = pow(int(MIX_A), -1, 1 << 64)
    return up, np.multiply.accumulate(table)


def _inside(windows, width, n):
    """Which of ``n`` words lie in one of the windows that start at ``windows``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data):
    """The ``COLUMNS`` of a list of encoded texts, as one integer array each."""
    n_docs = len(data)
    buffer, starts, ends, doc = words(data, fold=False)
    hashes = word_hashes(buffer, starts, ends)
    place = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, n_docs))
    chars = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
    size = chars[ends] - chars[starts]

    def per_doc(of, weight=None):
        return np.bincount(of, weight, n_docs).astype(np.int64)

    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, size)}
    symbols = np.flatnonzero(np.isin(buffer, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_symbols"] = per_doc(np.searchsorted(place, symbols, "right"))

    breaks = np.flatnonzero(buffer == 10)
    line_starts = np.concatenate(([0], breaks[:-1] + 1))
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, breaks)
    full = last > first
    line_starts, line_ends, first, last = line_starts[full], breaks[full], first[full], last[full]
    line_doc = np.searchsorted(place, line_starts, "right")
    salt = mix((np.arange(n_docs, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))
    _, later = _groups(mix(word_hashes(buffer, line_starts, line_ends) ^ salt[line_doc]))
    in_words = np.concatenate(([0], np.cumsum(size)))
    out["n_lines"], out["n_dup_lines"] = per_doc(line_doc), per_doc(line_doc[later])
    out["dup_line_chars"] = per_doc(line_doc[later], (in_words[last] - in_words[first])[later])

    up, down = _powers(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
    found = np.flatnonzero(doc[BASE_NGRAM - 1:] == doc[:max(len(doc) - BASE_NGRAM + 1, 0)]) if len(doc) >= BASE_NGRAM else np.zeros(0, np.int64)
    for n in range(BASE_NGRAM, max(NGRAM_SHARE) + 1):
        if n > BASE_NGRAM:  # a window can only repeat if the two shorter windows in it do
            both = np.zeros(len(doc) + 1, bool)
            both[found] = True
            found = found[both[found + 1]]
            found = found[doc[np.minimum(found + n - 1, len(doc) - 1)] == doc[found]]
        keys = mix((total[found + n] - total[found]) * down[found] ^ salt[doc[found]])
        repeated, later = _groups(keys)
        if n == BASE_NGRAM:
            out["n_repeat_words"] = per_doc(doc[_inside(found[repeated], n, len(doc))])
        if n in NGRAM_SHARE:
            hit = _inside(found[later], n, len(doc))
            out[f"chars_{n}"] = per_doc(doc[hit], size[hit])
        found = found[repeated]
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COLUMNS]))
def repetition(text: pd.Series) -> pd.DataFrame:
    parts = [pd.DataFrame(measure(held)) for _, held in chunks(text, CHUNK)]
    return (pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=COLUMNS, dtype="int64"))[COLUMNS]


def verdict(m):
    """Columns ``base_failed`` and ``kept`` over a struct of the counts."""
    base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
    repeats = (m["n_dup_lines"] > LINE_SHARE * m["n_lines"]) | (m["dup_line_chars"] > LINE_CHAR_SHARE * m["word_chars"])
    for n, share in NGRAM_SHARE.items():
        repeats = repeats | (m[f"chars_{n}"] > share * m["word_chars"])
    return base, ~(base | repeats)


def repetition_report(docs):
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``.

    Words are maximal runs without white space, lines are cut at ``\\n`` and count if they hold a word; characters are code points
    inside words. ``chars_n`` counts characters of words inside an n-gram that occurred before in the text, each word
    once; ``dup_line_chars`` those of lines that equal an earlier line. NULL and empty texts have no words, so they fail the base
    rules. Equal n-grams and lines are told by 64-bit hashes. Repeated rows are measured alike. Columns of the
    input other than ``doc_id`` and ``text`` are left out.
    """
    rows = docs.select("doc_id", repetition("text").alias("m"))
    base, kept = verdict(F.col("m"))
    return rows.select("doc_id", "m.*", base.alias("base_failed"), kept.alias("kept"))
