from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import hilbert, mixing
from tapeloom.llm.common import utf8_size, word_count


def test_hilbert_curve_visits_every_cell_by_unit_steps(spark):
    for dims, bits in ((2, 3), (3, 3)):
        axes = [f"a{i}" for i in range(dims)]
        cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"{a} int" for a in axes))
        kept = cells.select(*axes, *[F.col(a).alias(f"k{a}") for a in axes])
        found = {r.h: [r[f"k{a}"] for a in axes] for r in hilbert.with_hilbert(kept, axes, bits, "h").collect()}
        assert sorted(found) == list(range(1 << bits * dims))
        steps = [sum(abs(x - y) for x, y in zip(found[i], found[i + 1])) for i in range(len(found) - 1)]
        assert set(steps) == {1}


def test_levels_have_equal_depth(spark):
    df = spark.createDataFrame([(v,) for v in [None, None, 1, 2, 2, 2, 3, 4, 5, 9]], "v int")
    cuts = hilbert.depth_cuts(df, "v", 2)
    got = {r.v: r.level for r in df.select("v", hilbert.level_of(F.col("v"), cuts).alias("level")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 9: 2, None: 3}  # smaller rows * 4 // 10


def test_shards_are_even_gapless_runs_of_the_curve(docs, rows):
    out = hilbert.hilbert_shards(docs, ["source", "lang", "n_chars"], ["doc_id", "text"], shards=8).collect()
    assert len(out) == len(rows) and "row" in out[0].asDict() and out[0]["row"] == "clash"
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    placed = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert placed == sorted(placed)


def test_no_rows_and_fewer_rows_than_shards(spark, nothing, docs):
    assert hilbert.hilbert_shards(nothing, ["source"], ["doc_id"]).count() == 0
    few = hilbert.hilbert_shards(docs.where("doc_id in (1, 2, 3)"), ["source"], ["doc_id"]).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert mixing.mix(nothing, "n_chars").count() == 0


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        scale = sum(weight[s] for s in names if s not in full)
        found = {s: cap * sizes[s] if s in full else rest * weight[s] / scale for s in names}
        over = {s for s in names if s not in full and found[s] > cap * sizes[s]}
        if not over:
            return found
        full |= over


@pytest.fixture(scope="module")
def mixed(docs):
    # columns of the input that are called like added ones are replaced
    return mixing.mix(docs.withColumn("words", word_count("text")), "words", tie=("doc_id", "text")).cache()


def test_mix_meets_the_targets(docs, rows, mixed):
    out = mixed.collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.words
    want = targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.words and r.taken == sum(c.words for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_is_the_same_again_and_orders_by_time(docs, mixed):
    again = mixing.mix(docs.repartition(7).withColumn("words", word_count("text")), "words", tie=("doc_id", "text"))
    key = lambda df: sorted((str(r.doc_id), str(r.text), r.taken) for r in df.collect())
    assert key(again) == key(mixed)
    out = mixing.training_order(mixed, tie=("doc_id", "text")).orderBy("position").collect()
    assert [r.position for r in out] == list(range(len(out)))
    times = [r.time for r in out]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1


def test_weights_change_with_time(mixed):
    """The first source's weight falls, so its words come earlier on average than the third's, whose weight rises."""
    rows = mixing.training_order(mixed).groupBy("source").agg((F.sum(F.col("time") * F.col("words")) / F.sum("words")).alias("t")).collect()
    mean = {r.source: r.t for r in rows}
    assert mean["big"] < 0.5 < mean["s2"]


def test_sizes(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0b c\n",), ("é",)], "t string")
    assert [tuple(r) for r in df.select(utf8_size("t"), word_count("t")).collect()] == [(0, 0), (0, 0), (8, 3), (2, 1)]
