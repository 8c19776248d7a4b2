"""Centroid clustering by Ball k-means, in whole numbers.

Components become floor(256 * x), so distances and means are exact. Each round reads the vectors
once. The members of a cluster in a block of rows are a ball round its centroid, whose
radius is its farthest member's distance. Only centroids less than twice the radius away are
its neighbours. A member nearer than half the way to the nearest neighbour is in the stable core and is
compared with nothing; the others lie in annuli between half the ways to one neighbour and the next,
and are compared with the neighbours up to theirs, exactly. Which block a row is in changes
what is compared, never a result. Rows and their clusters are a new table after each round, whose
predecessor is deleted; what leaves the tasks else are sums for each cluster.

Vectors with another number of components, or with null or non-finite ones, and null vectors are left out. Components
beyond 2^27 after the change to whole numbers count as 2^27, so that a distance fits 64 bits; sums of
distances that don't are null. Fewer vectors than clusters give as many clusters as vectors. Of
rows with one id, or none (as if it were empty), the least vector comes first; repeated rows are vectors of their own, and of
clusters with equal centroids the first gets all. No vectors give no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stashed
from quillspark.sources import shared

CLUSTERS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
SEED = "2:"
LARGEST = 1 << 27
#: Rows that are looked at together.
ROWS = 1 << 14


def whole(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the whole components, of the vectors that can be clustered."""
    e = F.col("embedding")
    fits = (F.size(e) == dim) & F.forall(e, lambda x: F.abs(x.cast("double")) < float("inf"))
    number = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.lit(float(scale)) * x.cast("double")))))).cast("int")
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, number).alias("v"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors whose seeded hashes of the id are smallest."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.asarray([r["v"] for r in rows.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()], "int64")


def between(centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of centroids."""
    return np.stack([((centroids - c) ** 2).sum(1) for c in centroids])


def nearest(x: np.ndarray, centroids: np.ndarray, apart: np.ndarray, guess: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row of x, of equal ones the smaller number; and how many distances that took.

    apart: between(centroids). guess: each row's cluster of the round before; without it all are compared.
    """
    if guess is None:
        best, cluster = ((x - centroids[0]) ** 2).sum(1), np.zeros(len(x), "int32")
        for j in range(1, len(centroids)):
            d = ((x - centroids[j]) ** 2).sum(1)
            near = d < best
            best[near], cluster[near] = d[near], j
        return cluster, best, len(x) * len(centroids)
    cluster, best, made = guess.astype("int32").copy(), np.empty(len(x), "int64"), len(x)
    for i in np.unique(guess).tolist():
        ball = np.flatnonzero(guess == i)
        own = ((x[ball] - centroids[i]) ** 2).sum(1)
        inner = np.argsort(-own, kind="stable")  # the farthest first
        ball, own = ball[inner], own[inner]
        d, c = own.copy(), np.full(len(ball), i, "int32")
        # half the way is reached where four times the squared distance is the centroids' own
        neighbours = np.flatnonzero(apart[i] <= 4 * own[0])
        for j in neighbours[np.argsort(apart[i][neighbours], kind="stable")].tolist():
            if j == i:
                continue
            n = int(np.searchsorted(-4 * own, -apart[i, j], "right"))  # members of this annulus and those beyond
            to = ((x[ball[:n]] - centroids[j]) ** 2).sum(1)
            made += n
            near = (to < d[:n]) | (to == d[:n]) & (j < c[:n])
            d[:n][near], c[:n][near] = to[near], j
        best[ball], cluster[ball] = d, c
    return cluster, best, made


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, v, cluster and distance; rows with cluster are compared from there."""
    apart = between(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            v = table.column("v").combine_chunks()
            x = v.flatten().to_numpy().reshape(len(v), -1).astype("int64")
            guess = table.column("cluster").to_numpy() if "cluster" in table.column_names else None
            cluster, distance, _ = nearest(x, centroids, apart, guess)
            return pa.RecordBatch.from_arrays([table.column("vec_id").combine_chunks(), v, pa.array(cluster), pa.array(distance)], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= ROWS:
                yield done(held)
                held = []
        if held:
            yield done(held)

    return rows.mapInArrow(run, "vec_id bigint, v array<int>, cluster int, distance bigint")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids, each the floor of its members' mean; those without members stay."""
    dim = centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(dim)))
    out = centroids.copy()
    for r in sums.collect():  # a row for each cluster
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark, run = vectors.sparkSession, uuid.uuid4().hex
    rows = whole(vectors, dim)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for r in range(rounds + 1):
        with shared.scope(f"balls-{run}-{r}"):
            rows = stashed(assigned(rows, centroids))
        if r:
            shared.cleared(spark, f"balls-{run}-{r - 1}")
        if r < rounds:
            centroids = moved(rows, centroids)
    each = {x["cluster"]: x["s"] for x in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: int(n) if n < 1 << 63 else None
    told = [(c, fits(s), fits(sum(each.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in each.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
