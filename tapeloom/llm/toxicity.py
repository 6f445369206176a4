"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled ones."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import textmath
from .common import small_batches

DIM = 1 << 18
PREFIXES = (4, 5)
MAX_POSITIVE, MAX_UNLABELLED = 4000, 16000
LIFT, LEAST = 6.0, 3
LOW, HIGH = 1.0, 1.1


def features(data, known=None, dim=DIM):
    """``(indptr, index)``: the distinct hashed words and word beginnings of each encoded text, the ``known`` ones if given."""
    buffer, starts, ends, doc = textmath.words(data, textmath.ALNUM)
    parts, owners = [textmath.word_hashes(buffer, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        head = textmath.word_hashes(buffer, starts[long], starts[long] + n)
        parts.append(textmath.mix(head + np.uint64(n)))
        owners.append(doc[long])
    index, owner = (np.concatenate(parts) % np.uint64(dim)).astype(np.int64), np.concatenate(owners)
    if known is not None:
        index, owner = index[known[index]], owner[known[index]]
    keys = np.unique(owner * dim + index)
    indptr = np.searchsorted(keys, np.arange(len(data) + 1) * dim)
    return indptr, keys % dim


def _sums(weights, indptr, index):
    total = np.concatenate(([0.0], np.cumsum(weights[index])))
    return total[indptr[1:]] - total[indptr[:-1]]


def score_texts(texts, model):
    """Probability of each text to be toxic; without words only the bias speaks."""
    out = np.zeros(len(texts))
    for first, data in textmath.chunks(texts):
        indptr, index = features([d.decode("utf-8").lower().encode("utf-8") for d in data], model["known"])
        out[first:first + len(data)] = _sums(model["weights"], indptr, index) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit_nnpu(positive, unlabelled, prior, dim=DIM, steps=750, batch=256, rate=0.02, decay=1e-4, seed=7):
    """Linear classifier by the non-negative risk of Kiryo et al. (2017) with the logistic loss.

    ``positive`` and ``unlabelled`` are lists of index arrays. Each step takes a batch of both and descends the estimated
    risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; while the second part is negative, it climbs that part
    alone, so the model cannot explain the unlabelled toxic texts away. Adam steps; deterministic for a seed.
    """
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(dim), 0.0
    m, v, step = np.zeros(dim + 1), np.zeros(dim + 1), 0
    rows = lambda sample, order: ([len(sample[i]) for i in order], np.concatenate([sample[i] for i in order]))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    while step < steps:
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u = order[at:at + batch]
            p = rng.integers(0, len(positive), batch)
            (lu, iu), (lp, ip) = rows(unlabelled, u), rows(positive, p)
            fu = _sums(weights, np.concatenate(([0], np.cumsum(lu))), iu) + bias
            fp = _sums(weights, np.concatenate(([0], np.cumsum(lp))), ip) + bias
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gu, gp_minus, gp_plus = sigmoid(fu) / len(fu), sigmoid(fp) / len(fp), -sigmoid(-fp) / len(fp)
            if negative >= 0:
                gu, gp = gu, prior * (gp_plus - gp_minus)
            else:
                gu, gp = -gu, prior * gp_minus
            grad = np.bincount(iu, np.repeat(gu, lu), dim) + np.bincount(ip, np.repeat(gp, lp), dim) + decay * weights
            grad = np.append(grad, gu.sum() + gp.sum())
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            weights -= move[:-1]
            bias -= move[-1]
    return weights, bias


def choose_features(in_positive, in_unlabelled, positives, unlabelled, lift=LIFT, least=LEAST):
    """Mask of the features in ``least`` positives or more whose share there exceeds the rest's by ``lift`` standard errors.

    Takes the number of rows that hold each feature and the sizes of the two samples.
    """
    base = (in_unlabelled + 1) / (unlabelled + 2)
    share = in_positive / max(positives, 1)
    return (in_positive >= least) & (share - base >= lift * np.sqrt(base * (1 - base) / max(positives, 1)))


def prior_threshold(scores, prior, low=LOW, high=HIGH):
    """The score to cut at: the widest gap where between ``low`` and ``high`` times the class prior lies above it."""
    ranked = np.sort(scores)[::-1]
    first = min(max(int(low * prior * len(ranked)), 1), len(ranked) - 1)
    last = min(max(int(np.ceil(high * prior * len(ranked))), first + 1), len(ranked))
    gaps = ranked[first - 1:last - 1] - ranked[first:last]
    at = first + int(np.argmax(gaps))
    if ranked[at - 1] == ranked[at]:  # one run of ties: cut above it, or keep 0 where nothing is above
        above = ranked[ranked > ranked[at]]
        return (above[-1] + ranked[at]) / 2 if len(above) else 0.0
    return (ranked[at - 1] + ranked[at]) / 2


def held_out(doc_id):
    """Rows whose labels are never learnt from; a row without an id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels, label, doc_id="doc_id"):
    """(doc_id, label) of the rows to learn from, one per id; of contradicting rows the larger label holds."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    return rows.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("label"))


def train(docs, labels, text="text", doc_id="doc_id", label="toxic", max_positive=MAX_POSITIVE, max_unlabelled=MAX_UNLABELLED):
    """Learn from at most ``max_positive`` confirmed toxic rows and ``max_unlabelled`` rows whose label is not looked at.

    Both samples are the rows of ``labels`` with the smallest hash of their id, outside the held-out fold; the class prior
    is the share of toxic rows among all labels outside that fold. The texts of the samples are found by a broadcast of
    the sampled ids, a bounded table; only the counts of the features and each row's chosen ones come to the driver. After training, the bias moves the cut to the gap in the scores of the unlabelled
    sample that leaves about the class prior above it. Without a confirmed toxic row the model scores 0.
    """
    small_batches(docs.sparkSession)
    known = training_labels(labels, label, doc_id)
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0))).first()
    empty = {"weights": np.zeros(DIM), "bias": -50.0, "known": np.zeros(DIM, bool)}
    if not toxic or toxic == total:
        return empty
    ranked = known.withColumn("_h", F.xxhash64("_id", F.lit("sample")))
    some = ranked.where("label = 1").orderBy("_h", "_id").limit(max_positive).select("_id", F.lit(True).alias("_p"), F.lit(False).alias("_u"))
    rest = ranked.orderBy("_h", "_id").limit(max_unlabelled).select("_id", F.lit(False).alias("_p"), F.lit(True).alias("_u"))
    sample = some.union(rest).groupBy("_id").agg(F.max("_p").alias("_p"), F.max("_u").alias("_u"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")

    def extract(batches):
        for batch in batches:
            for first, data in textmath.chunks(batch["_text"]):
                indptr, index = features([d.decode("utf-8").lower().encode("utf-8") for d in data])
                part = batch.iloc[first:first + len(data)]
                yield pd.DataFrame({"_id": part["_id"].to_numpy(), "_p": part["_p"].to_numpy(), "_u": part["_u"].to_numpy(),
                                    "index": [index[a:b].astype(np.int32).tobytes() for a, b in zip(indptr[:-1], indptr[1:])]})

    id_type = docs.schema[doc_id].dataType.simpleString()
    found = cut(rows.mapInPandas(extract, f"_id {id_type}, _p boolean, _u boolean, index binary"))

    def count(batches):
        totals = np.zeros((2, DIM + 1), np.int64)
        for batch in batches:
            for i, name in enumerate(("_p", "_u")):
                part = batch.loc[batch[name], "index"]
                totals[i, :DIM] += np.bincount(np.frombuffer(b"".join(part), np.int32), minlength=DIM)
                totals[i, DIM] += len(part)
        at = np.flatnonzero(totals.any(axis=0))
        yield pd.DataFrame({"feature": at, "p": totals[0, at], "u": totals[1, at]})

    totals = np.zeros((2, DIM + 1), np.int64)
    held = found.mapInPandas(count, "feature int, p long, u long").groupBy("feature").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")).where(f"p >= {LEAST} or feature = {DIM}").toPandas()
    totals[:, held["feature"].to_numpy(int)] = held[["p", "u"]].to_numpy().T
    mask = choose_features(totals[0, :DIM], totals[1, :DIM], totals[0, DIM], totals[1, DIM])
    if not totals[0, DIM] or not totals[1, DIM]:
        return empty
    chosen = np.flatnonzero(mask)

    def choose(batches):
        known = np.zeros(DIM, bool)
        known[chosen] = True
        for batch in batches:
            parts = [np.frombuffer(b, np.int32) for b in batch["index"]]
            yield batch.assign(index=[x[known[x]].tobytes() for x in parts])

    small = found.mapInPandas(choose, found.schema).toPandas().sort_values(["_id", "index"], kind="stable")
    decode = lambda part: [np.frombuffer(b, np.int32).astype(np.int64) for b in part["index"]]
    positive, unlabelled = decode(small[small["_p"]]), decode(small[small["_u"]])
    weights, bias = fit_nnpu(positive, unlabelled, toxic / total)
    if len(unlabelled) > 1:
        lengths = np.array([len(row) for row in unlabelled])
        scores = _sums(weights, np.concatenate(([0], np.cumsum(lengths))), np.concatenate(unlabelled))
        bias = bias - prior_threshold(scores + bias, toxic / total)
    return {"weights": weights, "bias": float(bias), "known": mask}


def toxicity(text, model):
    """Score column in [0, 1] for a text column: the trained model, sent to every task once. NULL scores like an empty text."""
    at = np.flatnonzero(model["known"])
    small = {"at": at, "weights": model["weights"][at], "bias": model["bias"]}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, known = np.zeros(DIM), np.zeros(DIM, bool)
        weights[small["at"]], known[small["at"]] = small["weights"], True
        return pd.Series(score_texts(texts, {"weights": weights, "known": known, "bias": small["bias"]}))

    return score(text)
