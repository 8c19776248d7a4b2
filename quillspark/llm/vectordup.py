"""Near duplicates of vectors by p-stable hashing, with exact cosines.

Vectors of length one are projected on random Gaussian directions, shifted and cut into cells of
CELL; a table's key is the cells of some of them together. Two unit vectors of cosine 0.95 are
0.316 apart, so that one direction puts them in one cell with a known probability; from it and the number of
vectors follow how many directions a key takes (unrelated vectors seldom share one) and how many
tables there are (MISSED is the most that such a pair is missed by; nearer ones are missed less).

Equal vectors are one node first. Every node is compared with the first one of each bucket it
is in. Nodes within half the angle of 0.95 of such a one are a ball: any two of them are
linked, by the triangle inequality, and are only counted. Then balls that share a bucket are compared: a
bucket's balls are dealt to blocks, and each pair of blocks is one matrix product, which gives only pairs
that can be linked. Two balls whose centres and radii prove that all or none of their members are linked are
counted so; else members are compared with the other centre, and those that this doesn't decide with the members.
So a group of near copies, however large, never becomes pairs. Links between balls join them to components
by alternating stars. A pair counts as linked only by a cosine of 0.95 or more in double precision,
or by bounds that prove it.

Vectors that are null, empty, zero, or hold null or non-finite components are alone, as are those of another number
of components than each other. Rows are nodes, whatever their ids: equal ids may be in different components. Null ids
are in no component's name, unless no row in it has an id. No rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import stashed
from quillspark.llm.neardup import components

SIMILAR = 0.95
#: Width of a cell, in units of unit vectors' distances.
CELL = 2.0
MISSED = 0.08
#: How many unrelated vectors share a bucket with a vector, on average, in each table.
STRANGERS = 0.1
#: Balls of a bucket that are compared with as many others at a time.
BLOCK = 256
SEED = 13
#: What rounding may do to an angle.
MARGIN = 1e-7


def agreed(distance: float, cell: float = CELL) -> float:
    """The probability that a direction puts two vectors of that distance in one cell."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def planned(n: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Directions of a key, and tables, for n vectors."""
    near, far = agreed(math.sqrt(2 - 2 * similar)), agreed(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(2.0, n / STRANGERS)) / -math.log(far)))
    return k, math.ceil(math.log(MISSED) / math.log1p(-(near**k)))


@lru_cache(maxsize=4)
def _directions(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.default_rng([SEED, dim])
    a, b = g.standard_normal((dim, k * tables)), g.random(k * tables) * CELL
    return a, b, g.integers(1, 1 << 62, k * tables, dtype="int64").astype("uint64") * np.uint64(2) + np.uint64(1)


def keys_of(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The key of each row of unit in each table, of all tables and numbers of components different ones."""
    a, b, odd = _directions(unit.shape[1], k, tables)
    cells = np.floor((unit @ a + b) / CELL).astype("int64").astype("uint64")
    h = (cells * odd).reshape(len(unit), tables, k).sum(2, dtype="uint64") + np.arange(1, tables + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1])
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view("int64")


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors given as bytes, all of one number of components, with length one; the same for a vector in any company."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("float64")
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def signed(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, row (a number of its own), digest and raw, the components as bytes; the last two null for what links with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("row", pa.int64()), ("digest", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, digests = [], []
            for v in batch.column(1).to_pylist():
                x = np.asarray([] if v is None or None in v else v, kind) + 0  # no negative zeros
                some = len(x) and np.isfinite(x).all() and x.any()
                raw.append(x.tobytes() if some else None)
                digests.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if some else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(row, row + len(raw)), pa.int64()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], schema=schema)
            row += len(raw)

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, row bigint, digest binary, raw binary")


def keyed(nodes: DataFrame, kind: str, k: int, tables: int) -> DataFrame:
    """node, and key, that of the node's bucket, for each table, from node and raw."""
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys: list = [None] * len(raw)
            for size in {len(r) for r in raw}:
                own = [i for i, r in enumerate(raw) if len(r) == size]
                for i, x in zip(own, keys_of(units_of([raw[i] for i in own], kind), k, tables).tolist()):
                    keys[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, schema.field(1).type)], schema=schema)

    return nodes.select("node", "raw").mapInArrow(run, "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key"))


def with_angle(pairs: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """keep columns of pairs, cosine and angle of the vectors u and w (as bytes)."""
    old = [pairs.schema[c] for c in keep]
    schema = T.StructType([*old, T.StructField("cosine", T.DoubleType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            c = np.zeros(len(x))
            for size in {len(v) for v in x}:
                own = [i for i, v in enumerate(x) if len(v) == size]
                c[own] = np.einsum("ij,ij->i", *(units_of([v[i] for i in own], kind) for v in (x, y)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(c), pa.array(np.arccos(np.clip(c, -1, 1)))], names=[*keep, "cosine", "angle"])

    return pairs.select(*keep, "u", "w").mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int, work: Callable[[pa.Table], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that work gives for each run of rows with equal first n_keys columns, which must be sorted."""
    held: pa.Table | None = None

    def rows(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table | None]:
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        edges = [0, *new.tolist(), *([table.num_rows] if last else [])]
        out = [r for a, b in zip(edges, edges[1:]) for r in work(table.slice(a, b - a))]
        return out, None if last else table.slice(edges[-1])

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * len(schema), schema)], schema=schema)

    for batch in batches:
        if batch.num_rows:
            own = pa.Table.from_batches([batch])
            found, held = rows(pa.concat_tables([held, own]).combine_chunks() if held is not None else own, False)
            yield batch_of(found)
    if held is not None:
        yield batch_of(rows(held, True)[0])


def near_balls(entries: DataFrame, widest: float, kind: str) -> DataFrame:
    """a, b (a < b), cosine and angle of balls that share a key and may have linked members.

    entries: key, ball, raw (its centre), radius and size, the number of the key's balls.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def work(t: pa.Table) -> list[tuple]:
        balls, radius = t.column("ball").to_numpy(), t.column("radius").to_numpy()
        x = units_of(t.column("raw").to_pylist(), kind)
        first = t.column("block").to_numpy() == t.column("low").to_numpy()
        same = t.column("low")[0] == t.column("high")[0]
        i, j = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        c = x[i] @ x[j].T
        reach = np.minimum(math.pi, widest + MARGIN + radius[i][:, None] + radius[j][None, :])
        p, q = np.nonzero(c >= np.cos(reach))
        return [(int(min(a, b)), int(max(a, b)), float(v)) for a, b, v in zip(balls[i[p]], balls[j[q]], c[p, q]) if a != b and (not same or a < b)]

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("ball"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "ball", "radius", "raw")
    found = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(lambda b: grouped(b, 3, work, schema), "a bigint, b bigint, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))))


def linked(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of vectors (vec_id, embedding)."""
    theta = math.acos(similar)
    kind = "float32" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "float64"
    vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<float>" if kind == "float32" else "array<double>"))
    k, tables = planned(vectors.count(), similar)
    rows = stashed(signed(vectors, kind))
    some = rows.where("digest IS NOT NULL")
    nodes = stashed(some.groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")))
    units = stashed(some.select(F.col("row").alias("node"), "raw").join(nodes.select("node").hint("merge"), "node"))
    vector = lambda node, name: units.select(F.col("node").alias(node), F.col("raw").alias(name)).hint("merge")

    # buckets of more than one node, and each node's comparison with their first ones
    in_buckets = keyed(units, kind, k, tables)
    groups = stashed(in_buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader"))
    members = stashed(in_buckets.join(groups.hint("merge"), "key"))
    pairs = members.where("node <> leader").select("node", "leader").distinct()
    wide = pairs.join(vector("node", "u"), "node").join(vector("leader", "w"), "leader")
    half = stashed(with_angle(wide, kind, ["node", "leader"]).where(F.col("angle") <= theta / 2 - MARGIN))
    # each node is in the ball of the first one that it is so near to, or alone
    home = half.groupBy("node").agg(F.min(F.struct("leader", "angle")).alias("h")).select("node", F.col("h.leader").alias("ball"), F.col("h.angle").alias("radius"))
    homes = stashed(nodes.join(home, "node", "left").select("digest", "node", "weight", "first", F.coalesce("ball", "node").alias("ball"), F.coalesce("radius", F.lit(0.0)).alias("radius")))
    balls = stashed(homes.groupBy("ball").agg(F.sum("weight").alias("weight"), F.max("radius").alias("radius"), F.min("first").alias("first")))

    # balls that share a bucket
    entries = stashed(members.select("node", "key").join(homes.select("node", "ball").hint("merge"), "node").select("key", "ball").distinct())
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    centres = balls.select("ball", "radius").join(vector("ball", "raw"), "ball")
    near = near_balls(entries.join(sizes.hint("merge"), "key").join(centres.hint("merge"), "ball"), theta, kind)
    side = lambda c: balls.select(F.col("ball").alias(c), F.col("weight").alias(f"weight_{c}"), F.col("radius").alias(f"radius_{c}")).hint("merge")
    near = stashed(near.join(side("a"), "a").join(side("b"), "b"))
    wide_enough, single = F.col("angle") + F.col("radius_a") + F.col("radius_b") <= theta - MARGIN, F.col("radius_a") + F.col("radius_b") == 0
    sure = near.where(wide_enough | single & (F.col("cosine") >= similar))
    both = lambda d: d.select(F.col("a").alias("ball"), F.col("b").alias("to"), F.col("weight_b").alias("weight_to"), F.col("radius_b").alias("radius_to")).unionByName(d.select(F.col("b").alias("ball"), F.col("a").alias("to"), F.col("weight_a").alias("weight_to"), F.col("radius_a").alias("radius_to")))
    by_ball = both(sure).groupBy("ball").agg(F.sum("weight_to").alias("by_ball"))

    # members of balls that are linked in part: with the other centre, then with its members
    partly = both(near.where(~wide_enough & ~single))
    mine = partly.join(homes.select("node", "ball").hint("merge"), "ball").join(vector("node", "u"), "node").join(vector("to", "w"), "to")
    told = stashed(with_angle(mine, kind, ["node", "ball", "to", "weight_to", "radius_to"]))
    whole = told.where(F.col("angle") + F.col("radius_to") <= theta - MARGIN).select("node", "ball", "to", F.col("weight_to").alias("weight"))
    open_ = told.where((F.col("angle") + F.col("radius_to") > theta - MARGIN) & (F.col("angle") - F.col("radius_to") <= theta + MARGIN)).select("node", "ball", "to")
    each = open_.join(homes.select(F.col("ball").alias("to"), F.col("node").alias("other"), "weight").hint("merge"), "to")
    each = each.join(vector("node", "u"), "node").join(vector("other", "w"), "other")
    exact = with_angle(each, kind, ["node", "ball", "to", "weight"]).where(F.col("cosine") >= similar).select("node", "ball", "to", "weight")
    parts = stashed(whole.unionByName(exact))
    by_node = parts.groupBy("node").agg(F.sum("weight").alias("by_node"))

    edges = sure.select("a", "b").unionByName(parts.select(F.least("ball", "to").alias("a"), F.greatest("ball", "to").alias("b")).distinct())
    joined = components(edges.select(F.col("b").alias("node"), F.col("a").alias("leader")))
    named = stashed(balls.join(joined.select(F.col("node").alias("ball"), "leader").hint("merge"), "ball", "left").withColumn("component", F.coalesce("leader", "ball")).select("ball", "component", "weight", "first"))
    least = stashed(named.groupBy("component").agg(F.min("first").alias("component_id")))
    of_ball = named.join(least.hint("merge"), "component").join(by_ball.hint("merge"), "ball", "left").select("ball", "component_id", (F.col("weight") - 1 + F.coalesce("by_ball", F.lit(0))).alias("links"))
    of_node = stashed(homes.select("digest", "node", "ball").join(stashed(of_ball).hint("merge"), "ball").join(by_node.hint("merge"), "node", "left").select("digest", "component_id", (F.col("links") + F.coalesce("by_node", F.lit(0))).alias("n_links")))
    found = rows.select("vec_id", "digest").where("digest IS NOT NULL").join(of_node.hint("merge"), "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
