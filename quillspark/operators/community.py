"""Communities of a weighted undirected graph, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import stashed

TOP_LABELS = 5
#: Rounds of moves of a level, and levels, at most.
ROUNDS, LEVELS = 8, 6


def label_propagation(ids: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id and community after so many synchronous rounds, settled or not: the heaviest label of the neighbours, of equal ones the least.

    A page keeps its own label as one more vote, so that pairs don't swap labels for ever.
    Edges are (source, target, weight). Lineage ends at each third round.
    """
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("n"), "weight").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("n"), "weight"))
    both = stashed(both)
    own = both.groupBy("id").agg(F.max("weight").alias("weight"))
    labels = ids.select("id", F.col("id").alias("label"))
    for k in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("n"), "label"), "n").select("id", "label", "weight")
        votes = votes.unionByName(labels.join(own, "id").select("id", "label", "weight"))
        sums = votes.groupBy("id", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = sums.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("id", "b.label")
        labels = labels.select("id", F.col("label").alias("old")).join(best, "id", "left").select("id", F.coalesce("label", "old").alias("label"))
        if k % 3 == 2:
            labels = stashed(labels)
    return labels.select("id", F.col("label").alias("community"))


def components(ids: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id and the least id of its component, by hops and pointer jumps."""
    both = stashed(edges.select(F.col("source").alias("id"), F.col("target").alias("n")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("n"))).distinct())
    labels = stashed(ids.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("n"), "label"), "n").groupBy("id").agg(F.min("label").alias("m"))
        new = labels.join(near, "id", "left").select("id", F.least("label", "m").alias("label"))
        jumped = new.join(new.select(F.col("id").alias("label"), F.col("label").alias("further")), "label").select("id", F.least("label", "further").alias("label"))
        new = stashed(jumped)
        changed = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components not found in {rounds} rounds")


def _quality(links: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    """Modularity of state (id, degree, c); a node's degree beyond its links is its own loops."""
    ends = links.join(state.select("id", "c"), "id").join(state.select(F.col("id").alias("n"), F.col("c").alias("d")), "n")
    inside = ends.agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("weight"))), F.sum("weight")).first()
    loops = state.agg(F.sum("degree")).first()[0] - (inside[1] or 0.0)
    squares = state.groupBy("c").agg(F.sum("degree").alias("t")).agg(F.sum(F.pow(F.col("t") / F.lit(total), F.lit(2.0)))).first()[0]
    return ((inside[0] or 0.0) + loops) / total - resolution * squares


def _moved(links: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """state (id, degree, c) after rounds in which nodes join the neighbouring community of greatest gain, of equal ones the least.

    All nodes look at the same state, so in each round a half of them, by hash, stays; two
    single nodes never change places, as only the one with the greater id may join the other.
    """

    def sized(df: DataFrame) -> DataFrame:
        """With each community's sum of degrees, and whether it has one member."""
        size = df.groupBy("c").agg(F.sum("degree").alias("sum"), (F.count(F.lit(1)) == 1).alias("alone"))
        return stashed(df.join(size, "c"))

    state = sized(state)
    for k in range(rounds):
        beside = state.select(F.col("id").alias("n"), "c", "sum", "alone")
        votes = links.join(beside, "n").groupBy("id", "c").agg(F.sum("weight").alias("w"), F.first("sum").alias("s"), F.first("alone").alias("single"))
        near = votes.join(state.select("id", "degree", F.col("c").alias("own"), "sum", "alone"), "id")
        is_own = F.col("c") == F.col("own")
        gain = F.round(F.col("w") - resolution * F.col("degree") * (F.col("s") - F.when(is_own, F.col("degree")).otherwise(0.0)) / F.lit(total), 9)
        swap = F.col("single") & F.col("alone") & (F.col("c") > F.col("own"))
        none = F.round(-resolution * F.col("degree") * (F.col("sum") - F.col("degree")) / F.lit(total), 9)
        best = near.where(~swap).withColumn("gain", gain).withColumn("none", none).groupBy("id").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"), F.coalesce(F.max(F.when(is_own, F.col("gain"))), F.max("none")).alias("stay"), F.max("own").alias("own")
        )
        wants = best.where((-F.col("b.g") > F.col("stay")) & (F.col("b.c") != F.col("own"))).select("id", F.col("b.c").alias("to"))
        wants = stashed(wants)
        if wants.isEmpty():
            break
        goes = wants.where(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0)
        state = sized(state.select("id", "degree", "c").join(goes, "id", "left").select("id", "degree", F.coalesce("to", "c").alias("c")))
    return state.select("id", "degree", "c")


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """id and community, named by its first page, of nodes (id, ord) and edges (source, target, weight).

    The same at every size: each level moves nodes by joins on communities' sums until none wants
    to move, or rounds times, and makes communities the nodes of the next level; levels end when
    modularity no longer rises.
    """
    ends = edges.where("source <> target")
    both = ends.select(F.col("source").alias("id"), F.col("target").alias("n"), "weight").unionByName(ends.select(F.col("target").alias("id"), F.col("source").alias("n"), "weight"))
    links = stashed(both.groupBy("id", "n").agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    member = nodes.select("id", F.col("id").alias("node"))
    total = links.agg(F.sum("weight")).first()[0]
    state = stashed(links.groupBy("id").agg(F.sum("weight").alias("degree")).select("id", "degree", F.col("id").alias("c"))) if total else None
    quality = _quality(links, state, total, resolution) if total else 0.0
    for _ in range(levels if total else 0):
        state = _moved(links, state, total, resolution, rounds)
        now = _quality(links, state, total, resolution)
        if now <= quality + 1e-4:
            break
        quality = now
        member = stashed(member.join(state.select(F.col("id").alias("node"), "c"), "node", "left").select("id", F.coalesce("c", "node").alias("node")))
        named = links.join(state.select("id", "c"), "id").join(state.select(F.col("id").alias("n"), F.col("c").alias("d")), "n")
        links = stashed(named.where("c <> d").groupBy(F.col("c").alias("id"), F.col("d").alias("n")).agg(F.sum("weight").alias("weight")))
        state = stashed(state.groupBy("c").agg(F.sum("degree").alias("degree")).select(F.col("c").alias("id"), "degree", "c"))
    placed = member.join(nodes.select("id", "ord"), "id")
    first = placed.groupBy("node").agg(F.min_by("id", F.struct("ord", "id")).alias("community"))
    return placed.join(first, "node").select("id", "community")


def statistics(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """community, node_count, intra_edges, cohesion and top_nodes, from (id, label, link_count, community, ord)."""
    w = Window.partitionBy("community").orderBy(F.desc("link_count"), "ord")
    top = labelled.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP_LABELS)
    top = top.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("top_nodes"))
    sizes = labelled.groupBy("community").agg(F.count(F.lit(1)).alias("node_count"), F.min("ord").alias("first"))
    own = labelled.select("id", "community")
    inside = (
        edges.join(own.select(F.col("id").alias("source"), F.col("community").alias("c1")), "source")
        .join(own.select(F.col("id").alias("target"), F.col("community").alias("c2")), "target")
        .where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count(F.lit(1)).alias("intra_edges"))
    )
    n = F.col("node_count").cast("double")
    every = sizes.join(inside, "community", "left").na.fill(0, ["intra_edges"]).join(top, "community")
    return every.withColumn("cohesion", F.col("intra_edges") / F.greatest(F.lit(1.0), n * (n - 1) / 2))


def renumbered(stats: DataFrame) -> DataFrame:
    """stats with number, from 0: the largest first, of equal ones the one with the first page."""
    from quillspark.operators.ranking import ranked

    return ranked(stats, [F.desc("node_count"), F.col("first")], "number").withColumn("number", F.col("number") - 1)
