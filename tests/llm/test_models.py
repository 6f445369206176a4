import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import nn_descent, quality, toxicity

from .conftest import frame, prose


def corpus(spark, seed=4, n=600):
    """Toxic texts hold two words of a small family; poor texts shout or repeat themselves."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        words = prose(rng, rng.randrange(10, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "lowlife", "vermin"]) + rng.choice(["", "s", "ish"]))
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(4)]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, good, toxic, "x"))
    return frame(spark, rows + [(None, None, None, None), (n, "", None, None), (n + 1, None, None, None), (n + 2, "scoundrel lowlife " * 9000, None, None)]), \
        spark.createDataFrame(labels + [(None, 1, 1, "x"), (n, None, None, "x"), (5, labels[5][1], labels[5][2], "x")], "doc_id long, quality int, toxic int, text string")


def accuracy(scored, labels, name, cut):
    rows = scored.join(labels.dropDuplicates(["doc_id"]), "doc_id").where(F.col(name).isNotNull()).select("doc_id", "score", name).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50
    return np.mean([(r.score >= cut) == (r[name] == 1) for r in held])


@pytest.fixture(scope="module")
def data(spark):
    return corpus(spark)


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert spark.sql("select cast(null as long) id").select(toxicity.held_out(F.col("id"))).first()[0] is False


def test_toxicity_on_held_out_rows(data):
    docs, labels = data
    model = toxicity.train(docs, labels)
    scored = docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("score")).cache()
    assert accuracy(scored, labels, "toxic", 0.5) > 0.95
    empty = {r.score for r in scored.where("doc_id is null or doc_id in (600, 601)").collect()}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.5
    assert scored.where("doc_id = 602").first().score > 0.5
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model["weights"], again["weights"]) and model["bias"] == again["bias"]


def test_toxicity_does_not_learn_from_held_out_labels(data):
    docs, labels = data
    lied = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, lied)["bias"] == toxicity.train(docs, labels)["bias"]


def test_nnpu_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    positive = [np.array([0, 3 + i % 5]) for i in range(40)]
    unlabelled = positive[:20] + [np.array([1, 3 + int(rng.integers(40))]) for _ in range(180)]
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.1, dim=64)
    assert weights[0] + bias > 0 > weights[1] + bias


@pytest.mark.parametrize("train", [toxicity.train, quality.train])
def test_nothing_to_learn_from(spark, nothing, data, train):
    docs, labels = data
    for d, some in ((nothing, labels), (docs, labels.limit(0)), (nothing, labels.limit(0))):
        model = train(d, some)
        score = toxicity.toxicity if train is toxicity.train else quality.quality
        assert {r.s for r in docs.limit(5).select(score(F.col("text"), model).alias("s")).collect()} <= {0.5, 1 / (1 + np.exp(50))}


def test_quality_on_held_out_rows(data):
    docs, labels = data
    model = quality.train(docs, labels)
    scored = docs.select("doc_id", quality.quality(F.col("text"), model).alias("score")).cache()
    assert accuracy(scored, labels, "quality", 0.3) > 0.95
    assert {r.score for r in scored.where("doc_id in (600, 601)").collect()} == {float(model["labels"].mean())}
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_vote_equals_brute_force():
    rng = np.random.default_rng(1)
    x, y = quality._unit(rng.standard_normal((600, 8))), quality._unit(rng.standard_normal((90, 8)))
    labels = rng.integers(0, 2, 90).astype(float)
    want = []
    for v in x:
        s = y @ v
        near = np.argsort(-s)[:7]
        w = np.maximum(s[near], 0) ** 2 + 1e-9
        want.append((w * labels[near]).sum() / w.sum())
    assert np.allclose(quality.vote(x, y, labels, 7), want)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")


def brute_nearest(rows, is_query, k=5):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if is_query(q):
            scores = {}
            for i, y in good:
                if i != q:
                    scores[i] = max(scores.get(i, -2), float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))))
            out[q] = sorted(scores.items(), key=lambda kv: (-round(kv[1], 12), kv[0]))[:k]
    return out


def test_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(8)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # a hot vector
    rows += [(None, rows[1][1]), (3000, None), (3001, []), (3002, [0.0] * 8), (3003, [None] + [1.0] * 7), (3004, [float("nan")] * 8),
             (3005, [1.0] * 9), (3006, [float("inf")] + [0.0] * 7), rows[3], rows[3]]
    got = {}
    for r in nn_descent.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, lambda i: i % 10 == 0)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and len({v for _, v, _ in found}) == 5 and q not in {v for _, v, _ in found}
        worst = want[q][-1][1]
        hits += sum(s >= worst - 1e-9 for _, _, s in found)
        assert all(abs(s - dict(brute_scores(rows, q)).get(v, s)) < 1e-9 for _, v, s in found[:1])
    assert hits >= 0.95 * 5 * len(got)
    assert [v for _, v, _ in got[0]] == [2000, 2001, 2002, 2003, 2004]


def brute_scores(rows, q):
    x = np.array(next(v for i, v in rows if i == q))
    return [(i, float(x @ np.array(v) / (np.linalg.norm(x) * np.linalg.norm(v)))) for i, v in rows if i is not None and i < 2060]


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1e200]), (3, [2e-200, 0.0])]
    out = nn_descent.nearest(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [3, 1, 2] and abs(out[1].score - 0.5 ** 0.5) < 1e-12 and out[0].score == 1.0
    assert nn_descent.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0
    assert nn_descent.nearest(vectors(spark, rows[:1]), F.col("vec_id") == 0).count() == 0


def test_search_from_outside(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    nodes = nn_descent.make_nodes(nn_descent._directions(nn_descent.clean_vectors(vectors(spark, rows))), 1)
    graph = nn_descent.build_graph(nodes)
    asked = nodes.limit(20).select(F.col("node").alias("q"), "unit")
    out = nn_descent.greedy_search(graph, nodes, asked, nn_descent.entry_points(nodes, asked))
    best = out.groupBy("q").agg(F.max_by("node", "sim").alias("node"))
    assert best.where("q = node").count() >= 19


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(16)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(70)]
    rows += [(70 + i, (x * (i + 1) / 7).tolist()) for i in range(30)] + [(100, (x + 0.01 * rng.standard_normal(16)).tolist())]
    got = nn_descent.nearest(vectors(spark, rows), F.col("vec_id").isin(99, 100)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100] == [70, 71, 72, 73, 74]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 99] == [70, 71, 72, 73, 74]
    assert all(r.score == 1.0 for r in got if r.query_id == 99)


def test_every_vector_length_has_its_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [3.0, 2.0, 1.0]), (52, [1.0, 2.0, 2.0, 1.0])]
    got = nn_descent.nearest(vectors(spark, rows), F.col("vec_id").isin(0, 50, 52)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 1), (50, 1, 51)]


def test_rounds_earn_the_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    nodes = nn_descent.make_nodes(nn_descent._directions(nn_descent.clean_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]))), 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    true = np.argsort(-sims, axis=1)[:, :10]
    ids = {r.node: r.ids[0] for r in nodes.select("node", "ids").collect()}

    def recall(graph):
        near = {ids[r.node]: {ids[e["nbr"]] for e in r.nbrs} for r in graph.collect()}
        return np.mean([len(set(t.tolist()) & near.get(i, set())) / 10 for i, t in enumerate(true)])

    assert recall(nn_descent.first_graph(nodes)) < 0.4
    assert recall(nn_descent.build_graph(nodes)) >= 0.9
