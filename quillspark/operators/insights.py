"""Findings about a labelled graph: surprising connections, gaps and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Structural pages, distant pairs of types, and how many findings are shown.
STRUCTURAL = ("index", "log", "overview")
DISTANT = ("source-concept", "concept-source", "source-synthesis", "synthesis-source", "query-entity", "entity-query")
SURPRISES, GAPS, BRIDGES, PREVIEW = 5, 8, 3, 5
SPARSE, SPARSE_NODES, BRIDGED = 0.15, 3, 3


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    side = lambda name, p: nodes.select(F.col("id").alias(name), F.col("type").alias(f"{p}_type"), F.col("community").alias(f"{p}_community"), F.col("link_count").alias(f"{p}_degree"))
    return edges.join(side("source", "s"), "source").join(side("target", "t"), "target")


def surprising_connections(nodes: DataFrame, edges: DataFrame, limit: int = SURPRISES) -> DataFrame:
    """Edges that score at least 3: source, target, score, reasons and key; the best first."""
    own = _ends(nodes, edges).where(~F.col("source").isin(*STRUCTURAL) & ~F.col("target").isin(*STRUCTURAL))
    most = nodes.agg(F.greatest(F.coalesce(F.max("link_count"), F.lit(1)), F.lit(1)).alias("most"))
    own = own.crossJoin(F.broadcast(most))
    crosses = F.col("s_community") != F.col("t_community")
    typed = F.col("s_type") != F.col("t_type")
    distant = typed & F.concat_ws("-", "s_type", "t_type").isin(*DISTANT)
    hub = (F.least("s_degree", "t_degree") <= 2) & (F.greatest("s_degree", "t_degree") >= F.col("most") * 0.5)
    weak = (F.col("weight") > 0) & (F.col("weight") < 2)
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(crosses, 3) + points(distant, 2) + points(typed & ~distant, 1) + points(hub, 2) + points(weak, 1)
    reasons = F.array_compact(
        F.array(
            F.when(crosses, F.lit("crosses community boundary")),
            F.when(distant, F.concat_ws(" ", F.lit("connects"), "s_type", F.lit("to"), "t_type")),
            F.when(typed & ~distant, F.lit("different types")),
            F.when(hub, F.lit("peripheral node links to hub")),
            F.when(weak, F.lit("weak but present connection")),
        )
    )
    key = F.concat_ws(":::", F.least("source", "target"), F.greatest("source", "target"))
    found = own.select("source", "target", score.cast("bigint").alias("score"), reasons.alias("reasons"), key.alias("key")).where("score >= 3")
    return found.orderBy(F.desc("score"), "key").limit(limit)


def isolated_pages(nodes: DataFrame) -> DataFrame:
    """Pages with at most one link, but for structural ones."""
    return nodes.where((F.col("link_count") <= 1) & (F.col("type") != "overview") & ~F.col("id").isin("index", "log"))


def sparse_communities(stats: DataFrame) -> DataFrame:
    return stats.where((F.col("cohesion") < SPARSE) & (F.col("node_count") >= SPARSE_NODES))


def bridges(nodes: DataFrame, edges: DataFrame, limit: int = BRIDGES) -> DataFrame:
    """Pages whose neighbours are of three communities or more, those with most first."""
    own = _ends(nodes, edges)
    near = own.select(F.col("source").alias("id"), F.col("t_community").alias("c")).unionByName(own.select(F.col("target").alias("id"), F.col("s_community").alias("c")))
    counted = near.where(~F.col("id").isin(*STRUCTURAL)).groupBy("id").agg(F.count_distinct("c").alias("n_communities")).where(F.col("n_communities") >= BRIDGED)
    placed = counted.join(nodes.select("id", "ord"), "id")
    return placed.orderBy(F.desc("n_communities"), "ord").limit(limit).drop("ord")


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, stats: DataFrame, limit: int = GAPS) -> DataFrame:
    """kind, title and place of gaps: one row for isolated pages, then sparse communities, then bridges."""
    alone = isolated_pages(nodes).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("isolated-node").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" isolated page"), F.when(F.col("n") > 1, "s").otherwise("")).alias("title"), F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"))
    thin = sparse_communities(stats).select(F.lit("sparse-community").alias("kind"), F.concat(F.lit("Sparse cluster: "), F.element_at("top_nodes", 1)).alias("title"), F.lit(1).alias("a"), F.col("first").cast("bigint").alias("b"))
    over = bridges(nodes, edges).join(nodes.select("id", "label"), "id").select(F.lit("bridge-node").alias("kind"), F.concat(F.lit("Key bridge: "), F.col("label")).alias("title"), F.lit(2).alias("a"), (-F.col("n_communities")).cast("bigint").alias("b"))
    return alone.unionByName(thin).unionByName(over).orderBy("a", "b", "title").limit(limit).select("kind", "title")


def without_dismissed(found: DataFrame, dismissed: DataFrame) -> DataFrame:
    return found.join(dismissed.select("key"), "key", "left_anti")
