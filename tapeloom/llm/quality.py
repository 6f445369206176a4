"""Text quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import textmath
from .toxicity import training_labels

WORDS, SHAPES, LEVELS = 2048, 2048, 8
RATIOS = 5
DIM = WORDS + SHAPES + LEVELS * RATIOS
WORD_WEIGHT, RATIO_WEIGHT = 0.3, 0.4
MAX_LABELLED, LATENT, NEIGHBOURS = 4000, 48, 25
BLOCK = 256

# Byte classes of token shapes: letters and digits by kind, every other ASCII sign is its own class.
CLASS = np.arange(256, dtype=np.uint64)
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = 48, 65, 97, 97


def terms(data):
    """(doc, term, value) of the terms of encoded texts; values of one kind are shares of a text's tokens.

    Terms are hashed words, hashed token shapes (``Ab!!`` is capital, small, sign; a token that repeats the one before it
    is a shape of its own), and levels of a few ratios of the whole text.
    """
    raw, starts, ends, doc = textmath.words(data, fold=False)
    tokens = np.bincount(doc, minlength=len(data))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    word = textmath.word_hashes(textmath.LOWER[raw], starts, ends)
    kind = CLASS[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    nth = np.cumsum(change)
    at = np.flatnonzero(change & textmath.NOT_SPACE[raw])
    owner = np.searchsorted(starts, at, "right") - 1
    run = np.minimum(nth[at] - nth[starts[owner]], 15).astype(np.uint64)
    shape = np.add.reduceat(textmath.mix(kind[at] * np.uint64(16) + run + np.uint64(1)), np.searchsorted(owner, np.arange(len(starts))))
    again = np.zeros(len(starts), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape_term = WORDS + (textmath.mix(shape) % np.uint64(SHAPES - 1)).astype(np.int64)
    shape_term[again] = WORDS + SHAPES - 1
    keys = np.concatenate((doc * DIM + (word % np.uint64(WORDS)).astype(np.int64), doc * DIM + shape_term))
    keys, counts = np.unique(keys, return_counts=True)
    out_doc, out_term = keys // DIM, keys % DIM
    value = counts / tokens[out_doc]
    distinct = np.bincount(np.unique(doc.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24)).astype(np.uint64) >> np.uint64(40), minlength=len(data))
    full = np.flatnonzero(tokens)
    n = tokens[full]
    size = np.bincount(doc, ends - starts, len(data))[full]
    per_byte = lambda mask: np.add.reduceat(mask.astype(np.int64), _offsets(data))[full] / np.maximum(size, 1)
    upper, sign = (raw >= 65) & (raw < 91), textmath.NOT_SPACE[raw] & ~textmath.ALNUM[raw]
    ratios = (distinct[full] / n, per_byte(upper) * 4, per_byte(sign) * 2, size / n / 16, np.log2(n + 1) / 16)
    levels = [WORDS + SHAPES + i * LEVELS + np.clip(r * LEVELS, 0, LEVELS - 1).astype(np.int64) for i, r in enumerate(ratios)]
    out_doc = np.concatenate((out_doc, np.tile(full, RATIOS)))
    out_term = np.concatenate((out_term, *levels))
    return out_doc, out_term, np.concatenate((value, np.ones(RATIOS * len(full)))).astype(np.float32)


def _offsets(data):
    lengths = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    return np.cumsum(lengths) - lengths


def weighted(doc, term, value, idf, rows):
    """Dense term vectors: roots of the shares times idf, each kind of terms scaled to its weight."""
    out = np.zeros((rows, DIM), np.float32)
    out[doc, term] = np.sqrt(value) * idf[term]
    for part, weight in ((slice(0, WORDS), WORD_WEIGHT), (slice(WORDS, WORDS + SHAPES), 1.0), (slice(WORDS + SHAPES, DIM), RATIO_WEIGHT)):
        length = np.linalg.norm(out[:, part], axis=1, keepdims=True)
        out[:, part] *= weight / np.maximum(length, 1e-12)
    return out


def latent_axes(matrix, rank, seed=5, rounds=4):
    """The leading right singular vectors of ``matrix`` by subspace iteration; deterministic for a seed."""
    rank = min(rank, *matrix.shape)
    basis = np.random.default_rng(seed).standard_normal((matrix.shape[1], rank)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    return basis.astype(np.float32)


def _unit(vectors):
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def vote(vectors, labelled, labels, neighbours=NEIGHBOURS):
    """Share of label 1 among the nearest labelled vectors, weighted by cosine; all cosines are computed, block by block."""
    out = np.zeros(len(vectors))
    k = min(neighbours, len(labelled))
    for at in range(0, len(vectors), BLOCK):
        cosine = vectors[at:at + BLOCK] @ labelled.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 2 + 1e-9
        out[at:at + BLOCK] = np.clip((weight * labels[near]).sum(1) / weight.sum(1), 0, 1)
    return out


def document_frequencies(docs, text="text"):
    """Number of documents that hold each term, over the whole table, and the number of documents."""

    def count(batches):
        total, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for _, data in textmath.chunks(batch["t"]):
                _, term, _ = terms(data)
                total += np.bincount(term, minlength=DIM)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(total[at], rows)})

    found = docs.select(F.col(text).alias("t")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM + 1)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out[:DIM], out[DIM]


def train(docs, labels, text="text", doc_id="doc_id", label="quality", max_labelled=MAX_LABELLED):
    """Latent-semantic space and labelled vectors, or None without labels to learn from.

    Term weights count all documents. The space and the voters come from at most ``max_labelled`` labelled rows, those with
    the smallest hash of their id outside the held-out fold; their texts are found by a broadcast of these ids.
    """
    known = training_labels(labels, label, doc_id)
    sample = known.withColumn("_h", F.xxhash64("_id", F.lit("quality"))).orderBy("_h", "_id").limit(max_labelled).select("_id", "label")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")

    def extract(batches):
        for batch in batches:
            for first, data in textmath.chunks(batch["_text"]):
                doc, term, value = terms(data)
                bounds = np.searchsorted(np.sort(doc), np.arange(len(data) + 1))
                order = np.argsort(doc, kind="stable")
                part = batch.iloc[first:first + len(data)]
                cut = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pd.DataFrame({"_id": part["_id"].to_numpy(), "label": part["label"].to_numpy(),
                                    "term": [term[c].astype(np.int16).tobytes() for c in cut],
                                    "value": [value[c].astype(np.float32).tobytes() for c in cut]})

    id_type = docs.schema[doc_id].dataType.simpleString()
    found = rows.mapInPandas(extract, f"_id {id_type}, label int, term binary, value binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["_id", "term", "value"], kind="stable")
    counts, total = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + counts)).astype(np.float32) + 1
    term = [np.frombuffer(t, np.int16).astype(np.int64) for t in found["term"]]
    doc = np.repeat(np.arange(len(found)), [len(t) for t in term])
    value = np.frombuffer(b"".join(found["value"]), np.float32)
    matrix = weighted(doc, np.concatenate(term), value, idf, len(found))
    axes = latent_axes(matrix, LATENT)
    return {"idf": idf, "axes": axes, "labelled": _unit(matrix @ axes), "labels": found["label"].to_numpy(np.float64)}


def quality(text, model):
    """Score column in [0, 1] for a text column. NULL and empty texts have no direction: they get the share of label 1.

    Without labelled rows every score is 0.5.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), 0.5)
        if model is None:
            return pd.Series(out)
        for first, data in textmath.chunks(texts):
            doc, term, value = terms(data)
            vectors = _unit(weighted(doc, term, value, model["idf"], len(data)) @ model["axes"])
            some = vote(vectors, model["labelled"], model["labels"])
            some[np.bincount(doc, minlength=len(data)) == 0] = model["labels"].mean()
            out[first:first + len(data)] = some
        return pd.Series(out)

    return score(text)
