"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, greedy search walks it.

Both run as Spark joins. Vectors travel as bytes: ``raw`` in double precision, ``unit`` of length one in single, ``half`` in
half precision for the local joins; final scores are computed from ``raw``.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from ..functions.storage import cut
from .common import shuffle_partitions

DEGREE, REVERSE = 24, 16
TREES, BITS, BLOCK = 3, 12, 16
BEAM, EXPAND, ENTRIES = 256, 64, 64
LEAST_CHANGE = 0.02
GRID = 2.0 ** 40  # directions that agree on this grid are one node
TIE = 12  # decimals of a score


def clean_vectors(rows, vec_id="vec_id", vector="embedding"):
    """(vec_id, raw) of the vectors that take part, of any length.

    Left out: NULL ids and vectors that are NULL, empty, zero or hold a NULL or non-finite component.
    """
    some = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    some = some.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))

    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "raw": [np.asarray(v, "<f8").tobytes() for v in batch["v"]]})

    return some.mapInPandas(pack, "vec_id long, raw binary").dropDuplicates()


def _matrix(blobs, dtype):
    data = np.frombuffer(b"".join(blobs), dtype)
    return data.reshape(len(blobs), -1) if len(blobs) else data.reshape(0, 0)


def _unit(raw):
    x = _matrix(raw, "<f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@F.pandas_udf(T.DoubleType())
def exact_cosine(x: pd.Series, y: pd.Series) -> pd.Series:
    """Cosine of two raw vectors in double precision; scaled first, so that no square overflows."""
    if not len(x):
        return pd.Series(np.zeros(0))
    a, b = _matrix(x, "<f8"), _matrix(y, "<f8")
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return pd.Series(np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))))


@F.pandas_udf(T.FloatType())
def _cosine(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series(np.zeros(0, np.float32))
    return pd.Series(np.einsum("ij,ij->i", _matrix(x, "<f4"), _matrix(y, "<f4")))


def _directions(vectors):
    """``vectors`` of one length with ``node``: the name of their direction, the same for scaled copies."""
    def name(batches):
        for batch in batches:
            unit = _unit(batch["raw"]) if len(batch) else np.zeros((0, 0))
            yield batch.assign(direction=[np.rint(u * GRID).astype("<i8").tobytes() for u in unit])

    named = vectors.mapInPandas(name, "vec_id long, raw binary, direction binary")
    return named.select("vec_id", "raw", F.xxhash64("direction").alias("node"))


def make_nodes(vectors, members):
    """(node, raw, unit, half, ids): one node per direction, with its ``members`` smallest ids, all that a result can need.

    ``vectors``: rows (vec_id, raw, node). ``raw`` is the vector of the smallest id.
    """
    ids = vectors.groupBy("node", "vec_id").agg(F.min("raw").alias("raw"))
    first = Window.partitionBy("node").orderBy("vec_id")
    few = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= members)
    nodes = few.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("raw", "vec_id").alias("raw"))

    def scale(batches):
        for batch in batches:
            unit = _unit(batch["raw"]) if len(batch) else np.zeros((0, 0))
            yield batch.assign(unit=[u.astype("<f4").tobytes() for u in unit], half=[u.astype("<f2").tobytes() for u in unit])

    return cut(nodes.select("node", "raw", "ids").mapInPandas(scale, "node long, raw binary, ids array<bigint>, unit binary, half binary"))


def _top(edges, degree):
    """(node, nbrs): the ``degree`` best distinct neighbours, best first, as (sim, nbr, new)."""
    best = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    ranked = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return best.withColumn("nth", ranked).where(F.col("nth") <= degree).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("sim", "nbr", "new")), asc=False).alias("nbrs"))


def _first_edges(nodes, degree):
    """A rough start: neighbours inside small blocks of ``TREES`` random partitions.

    A partition orders the nodes by the signs of random hyperplanes, then by a projection, and is cut into blocks of ``BLOCK`` to
    ``2 * BLOCK - 1`` rows. Blocks of several partitions interlock, else no round could leave a block; most true
    neighbours lie elsewhere, and the rounds have to find them.
    """
    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["half"], "<f2").astype(np.float32)
            for tree in range(TREES):
                planes = np.random.default_rng(tree).standard_normal((x.shape[1], BITS + 1)).astype(np.float32)
                y = x @ planes
                yield batch.assign(tree=tree, code=(y[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1]), along=y[:, BITS].astype(np.float64))

    def block_edges(batches):
        held = None
        for batch in batches:
            for tree, part in batch.groupby("tree", sort=True):
                if held is not None and held["tree"].iloc[0] != tree:
                    yield edges(held)
                    held = None
                held = part if held is None else pd.concat((held, part), ignore_index=True)
                full = max(len(held) // BLOCK - 1, 0)
                for start in range(0, full * BLOCK, BLOCK):
                    yield edges(held.iloc[start:start + BLOCK])
                held = held.iloc[full * BLOCK:].reset_index(drop=True)
        if held is not None and len(held):
            yield edges(held)

    def edges(rows):
        x, ids = _matrix(rows["half"], "<f2").astype(np.float32), rows["node"].to_numpy()
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        k = min(degree, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"node": ids[:0], "nbr": ids[:0], "sim": np.zeros(0, np.float32)})
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"node": np.repeat(ids, k), "nbr": ids[near].ravel(), "sim": np.take_along_axis(sims, near, 1).ravel()})

    placed = nodes.select("node", "half").mapInPandas(place, "node long, half binary, tree int, code long, along double")
    order = ["tree", "code", "along", "node"]
    dealt = placed.repartitionByRange(_parts(nodes), *order).sortWithinPartitions(*order)
    return dealt.select("tree", "node", "half").mapInPandas(block_edges, "node long, nbr long, sim float")


def _parts(df):
    return shuffle_partitions(df.sparkSession)


def _edges(graph):
    return graph.select("node", F.explode("nbrs").alias("e")).select("node", "e.*")


def _both_ways(graph):
    """(node, nbr, new): neighbours and, of the nodes that name it as one, the ``REVERSE`` most similar."""
    forward = _edges(graph)
    back = forward.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", "new")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    back = back.withColumn("nth", nth).where(F.col("nth") <= REVERSE)
    return forward.select("node", "nbr", "new").union(back.select("node", "nbr", "new")).groupBy("node", "nbr").agg(F.max("new").alias("new"))


def _local_joins(lists, nodes, graph):
    """Better edges found by comparing the neighbours of every node with each other, pairs with a new one only."""
    worst = graph.select("node", F.when(F.size("nbrs") >= DEGREE, F.element_at("nbrs", -1)["sim"]).otherwise(-2.0).cast("float").alias("worst"))
    busy = lists.where("new").select("node").distinct()
    sent = lists.join(busy, "node", "left_semi").select(F.col("node").alias("hub"), F.col("nbr").alias("node"), "new")
    sent = sent.join(nodes.select("node", "half").join(worst, "node"), "node")
    dealt = sent.repartition(_parts(nodes), "hub").sortWithinPartitions("hub", "node")

    def compare(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat((held, batch), ignore_index=True)
            hubs = rows["hub"].to_numpy()
            end = int(np.searchsorted(hubs, hubs[-1])) if len(hubs) else 0
            held = rows.iloc[end:].reset_index(drop=True)
            if end:
                yield joined(rows.iloc[:end])
        if held is not None and len(held):
            yield joined(held)

    def joined(rows):
        x, ids, hubs = _matrix(rows["half"], "<f2").astype(np.float32), rows["node"].to_numpy(), rows["hub"].to_numpy()
        worst_of, new = rows["worst"].to_numpy(), rows["new"].to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(hubs, prepend=hubs[0] - 1 if hubs[0] > -(1 << 62) else hubs[0] + 1)), len(hubs))
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            sims = x[a:b] @ x[a:b].T
            good = (new[a:b, None] | new[None, a:b]) & (sims > worst_of[a:b, None])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            parts.append((ids[a + i], ids[a + j], sims[i, j]))
        node, nbr, sim = (np.concatenate(c) for c in zip(*parts))
        keys = pd.DataFrame({"node": node, "nbr": nbr, "sim": sim})
        return keys.drop_duplicates(["node", "nbr"])

    return dealt.mapInPandas(compare, "node long, nbr long, sim float")


def first_graph(nodes):
    """The graph before the first round."""
    return cut(_top(_first_edges(nodes, DEGREE).withColumn("new", F.lit(True)), DEGREE))


def build_graph(nodes):
    """Neighbour graph (node, nbrs) over all nodes by NN-descent.

    Starts from ``TREES`` random partitions cut into small blocks, whatever the size of a cluster. Each round joins
    every node's neighbours, forward and reverse, with their vectors and compares them with each other; a node keeps the
    ``DEGREE`` best it has met. Rounds go on until fewer than ``LEAST_CHANGE`` of all edges change.
    """
    graph = first_graph(nodes)
    edges = nodes.count() * DEGREE
    while True:
        better = _local_joins(_both_ways(graph), nodes, graph).withColumn("new", F.lit(True))
        graph = cut(_top(_edges(graph).withColumn("new", F.lit(False)).unionByName(better), DEGREE))
        changed = graph.select(F.sum(F.size(F.filter("nbrs", lambda e: e["new"])))).first()[0] or 0
        if changed <= LEAST_CHANGE * edges:
            return graph


def entry_points(nodes, queries):
    """(q, node) starts of queries from outside: the ``ENTRIES`` nodes of smallest name, a broadcast of bounded size."""
    return queries.select("q").crossJoin(F.broadcast(nodes.select("node").orderBy("node").limit(ENTRIES)))


def greedy_search(graph, nodes, queries, starts, beam=BEAM):
    """(q, node, sim): the best nodes met for each query (q, unit) on a greedy walk through the graph.

    All queries walk at once. A step joins each query's ``EXPAND`` best nodes not looked at yet with the graph, computes the
    similarities of their neighbours and keeps the ``beam`` best; the walk ends when every kept node was looked at.
    """
    walk = cut(_both_ways(graph).groupBy("node").agg(F.collect_list("nbr").alias("around")))
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    state, seen = None, starts.select("q", "node").distinct()
    while True:
        found = seen.join(queries, "q").join(nodes.select("node", F.col("unit").alias("other")), "node")
        found = found.select("q", "node", _cosine("unit", "other").alias("sim"), F.lit(False).alias("done"))
        if state is not None:
            found = state.unionByName(found)
        ranked = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= beam)
        turn = F.row_number().over(Window.partitionBy("q").orderBy("done", "nth")) <= EXPAND
        state = cut(ranked.withColumn("go", ~F.col("done") & turn).drop("nth"))
        front = state.where("go")
        if front.isEmpty():
            return state.select("q", "node", "sim")
        near = front.select("q", "node").join(walk, "node").select("q", F.explode("around").alias("node")).distinct()
        state = state.select("q", "node", "sim", (F.col("done") | F.col("go")).alias("done"))
        seen = near.join(state.select("q", "node"), ["q", "node"], "left_anti")


def nearest(rows, is_query, k=5, vec_id="vec_id", vector="embedding"):
    """The ``k`` nearest rows found for each query row: query_id, rank, vec_id, score.

    ``is_query``: condition on ``vec_id`` that picks the queries; candidates are all rows of the same vector length but those
    of the query's own id. Nearness is the cosine of the original vectors in double precision, to ``TIE`` decimals; equal
    scores order by id. All nodes of a query's beam are scored so, before any is left out. Queries start at their own node of
    the graph. Vectors of one direction, copies scaled or not, are one node, so a hot vector costs no more than another, and any
    of them can be in a result. Each vector length has a graph of its own. Rows that repeat id and vector count once; an id
    with several vectors is a query and a candidate with each, and appears once, at its best score. Rows that
    ``clean_vectors`` leaves out take no part. No queries or no candidates give no rows.
    """
    vectors = cut(clean_vectors(rows, vec_id, vector))
    sizes = vectors.groupBy(F.octet_length("raw").alias("n")).agg(
        F.count("*").alias("rows"), F.max(is_query).alias("asked")).orderBy("n").collect()  # a row per vector length
    found = [_nearest(vectors.where(F.octet_length("raw") == s.n), is_query, k) for s in sizes if s.asked and s.rows > 1]
    if not found:
        return vectors.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    if len(found) > 1:  # an id may have vectors of several lengths
        out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(vectors, is_query, k):
    """``nearest`` among vectors of one length."""
    vectors = cut(_directions(vectors))
    nodes = make_nodes(vectors, k + 1)
    graph = build_graph(nodes)
    asked = cut(vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct())
    queries = cut(nodes.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("q"), "unit"))
    starts = graph.join(queries.select(F.col("q").alias("node")), "node", "left_semi").select(
        F.col("node").alias("q"), F.explode(F.concat(F.array("node"), F.transform("nbrs", lambda e: e["nbr"]))).alias("node"))
    starts = starts.union(queries.select("q", F.col("q").alias("node")))
    met = greedy_search(graph, nodes, queries, starts).select("q", "node")
    scored = met.join(nodes.select("node", F.col("raw").alias("y"), "ids"), "node").join(
        nodes.select(F.col("node").alias("q"), F.col("raw").alias("x")), "q").select(
        "q", "ids", F.round(exact_cosine("x", "y"), TIE).alias("score"))
    results = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    results = results.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * k + 2)
    out = asked.join(results, "q").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
