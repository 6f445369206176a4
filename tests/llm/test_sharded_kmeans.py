import hashlib
import math
import random

import pytest

from tapeloom.llm import sharded_kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(vectors, k=16, rounds=3, dims=64, scale=64):
    """One vector after the other, in Python's integers; rows with their number keep repeated ids apart."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < 2 ** 26 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        chosen = assign()
        for n in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, chosen) if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    chosen = assign()
    total = {n: sum(d for d, c in chosen if c == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, chosen)], key=repr)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def made(seed, n, dims=64):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(20)]
    return [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 20]]) for i in range(n)]


def float32(rows):
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("shards, run", [(4, 2048), (1, 7), (5, 13)])
def test_clusters_equal_brute_force(spark, monkeypatch, shards, run):
    monkeypatch.setattr(sharded_kmeans, "RUN", run)
    rows = float32(made(1, 300))
    assert result(sharded_kmeans.cluster(frame(spark, rows).repartition(6), shards=shards)) == brute(rows)


def test_unfit_vectors_ties_and_repeated_rows(spark):
    rows = made(2, 60) + [(500, [0.5] * 64)] * 40 + [(600 + i, [0.5] * 64) for i in range(40)]
    rows += [(700, None), (701, []), (702, [1.0] * 63), (703, [None] + [1.0] * 63), (704, [float("nan")] + [1.0] * 63),
             (705, [float("inf")] + [1.0] * 63), (706, [-1e30] * 64), (None, [0.25] * 64), (None, [0.3] * 64), (707, [0.0] * 64), (708, [-0.0] * 64),
             (709, [-300.7] * 64), (710, [2.0 ** 20 - 1] * 64)]
    rows = float32(rows)
    assert result(sharded_kmeans.cluster(frame(spark, rows))) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.1] * 64) for i in range(5)]
    assert result(sharded_kmeans.cluster(frame(spark, float32(same)))) == brute(float32(same))
    for rows in ([], [(1, None)], [(1, [1.0])]):
        assert result(sharded_kmeans.cluster(frame(spark, rows))) == []


def test_smaller_vectors_and_more_rounds(spark):
    rows = float32(made(3, 120, dims=5))
    assert result(sharded_kmeans.cluster(frame(spark, rows), k=4, rounds=6, dims=5, shards=2)) == brute(rows, k=4, rounds=6, dims=5)
