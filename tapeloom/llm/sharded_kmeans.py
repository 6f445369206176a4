"""Lloyd's clustering with the dimensions dealt over shards.

Vectors are stored once as blocks: a run of vectors by a slice of the dimensions. In a round the task of a block gives the
partial squared distances of its vectors to its slice of the centroids; the blocks of a run are added by key, which gives
whole distances and the nearest centroid. The chosen numbers go back to the blocks, every shard sums its own slice per
cluster and renews it. All arithmetic is in integers, so the result does not depend on the order of the sums. The driver
holds the centroids alone: ``k`` times the number of dimensions.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions.storage import cut
from .common import shuffle_partitions
from .files import shared_folder

RUN = 2048
BOUND = 1 << 26  # of a component, so that a squared distance over up to 64 dimensions fits a long
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def narrow(values):
    """The same integers in the smallest signed type that holds them."""
    low, high = (values.min(), values.max()) if values.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def add(a, b):
    return narrow(a.astype(np.int64) + b)


def quantised(vectors, dims, scale):
    """(vec_id, x): the vectors that take part, as integers ``floor(scale * component)``."""
    value = F.transform("embedding", lambda v: v.cast("double") * scale)
    good = (F.size("embedding") == dims) & F.forall(value, lambda v: F.coalesce(F.abs(v) < BOUND, F.lit(False)) & ~F.isnan(v))
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(value, lambda v: F.floor(v).cast("long")).alias("x"))


def first_centroids(rows, k, seed):
    """The components of the ``k`` rows with the smallest hash, rows without an id last; equal hashes by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.withColumn("h", order).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64)


def store_blocks(rows, dims, shards):
    """Write the blocks (run, n, kind, data, ids) below one folder per slice; only the first slice carries the ids."""
    cuts = np.linspace(0, dims, shards + 1).astype(int)

    def blocks(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                ids = part.column("vec_id").to_pylist()
                run, made = f"{task}-{made}", made + 1
                sides = [narrow(x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_pydict({
                    "run": [run] * shards, "shard": pa.array(range(shards), pa.int32()), "n": pa.array([len(x)] * shards, pa.int32()),
                    "kind": [s.dtype.str for s in sides], "data": [s.tobytes() for s in sides],
                    "ids": pa.array([ids] + [None] * (shards - 1), pa.list_(pa.int64()))})

    schema = "run string, shard int, n int, kind string, data binary, ids array<long>"
    path = shared_folder(rows.sparkSession, "blocks")
    rows.mapInArrow(blocks, schema).write.partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path), cuts


def matrix(block):
    return np.frombuffer(bytes(block["data"]), block["kind"]).reshape(block["n"], -1).astype(np.int64)


def partial_distances(block, slices):
    x = matrix(block)
    return narrow(np.stack([np.square(x - c).sum(1) for c in slices[block["shard"]]], axis=1))


def nearest(distances):
    """Number of and distance to the nearest centroid; of equal ones the smallest number."""
    which = distances.argmin(1)
    return narrow(which), narrow(np.take_along_axis(distances, which[:, None], 1)[:, 0])


def cluster_sums(block, which, k):
    """Per cluster the sum of the block's rows, and in a last column their number."""
    x = matrix(block)
    sums = np.zeros((k, x.shape[1] + 1), np.int64)
    np.add.at(sums, which, np.hstack((x, np.ones((len(x), 1), np.int64))))
    return sums


def renewed(sums, slice_):
    count = sums[:, -1:]
    return np.where(count > 0, sums[:, :-1] // np.maximum(count, 1), slice_)


def assigned(blocks, slices, parts):
    """RDD of (run, (numbers, distances)): partial distances of the blocks, added by key."""
    return (blocks.map(lambda b: (b["run"], partial_distances(b, slices))).reduceByKey(add, parts).mapValues(nearest))


def cluster(vectors, k=16, rounds=3, dims=64, scale=64, shards=4, seed=1):
    """One row per vector that takes part: its cluster, squared distance, the sums of these, and its centroid's digest.

    Vectors that are NULL, have another length or hold NULL, NaN or an infinite value take no part, nor do vectors with a
    component of 2**26 or more after scaling, whose squared distances a long cannot hold. Repeated rows are vectors of their
    own. A row without an id is assigned like any other and starts no centroid unless too few rows have ids. With
    fewer than ``k`` rows all of them start centroids; no rows give none. An inertia beyond a long is NULL. Other columns
    play no part.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, dims, scale)
    start = first_centroids(rows, k, seed)
    if len(start) == 0:
        return spark.createDataFrame([], RESULT)
    stored, cuts = store_blocks(rows, dims, shards)
    parts, k = shuffle_partitions(spark), len(start)
    slices = {s: start[:, a:b] for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))}
    blocks = stored.select("run", "shard", "n", "kind", "data").rdd
    for _ in range(rounds):
        chosen = assigned(blocks, slices, parts).mapValues(lambda found: found[0])
        sums = (blocks.map(lambda b: (b["run"], b)).join(chosen, parts)
                .map(lambda pair: (pair[1][0]["shard"], cluster_sums(pair[1][0], pair[1][1], k))).reduceByKey(np.add, shards))
        old = slices
        slices = old | dict(sums.map(lambda pair: (pair[0], renewed(pair[1], old[pair[0]]))).collect())
    final = assigned(blocks, slices, parts).map(lambda pair: (pair[0], pair[1][0].tolist(), pair[1][1].tolist()))
    final = cut(spark.createDataFrame(final, "run string, cluster array<int>, distance array<long>", verifySchema=False))
    ids = stored.where("shard = 0").select("run", "ids")
    rows = final.join(ids, "run").select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "cluster", "distance")))
    centroids = np.hstack([slices[s] for s in range(shards)])
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    totals = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in totals}

    def long(value):
        return value if value < 1 << 63 else None

    facts = [(i, long(inertia.get(i, 0)), long(sum(inertia.values())), digest) for i, digest in digests]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])
