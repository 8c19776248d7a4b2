"""Link graph: nodes, edges, degrees and relevance of pages to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import frontmatter as fm
from quillspark.operators.links import links, resolved
from quillspark.sources.shared import stashed

# Weights of the signals and affinity of page types.
DIRECT, SHARED_SOURCE, COMMON_NEIGHBOUR, AFFINITY = 3.0, 4.0, 1.5, 1.0
TYPE_AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source": 1.0, "synthesis": 1.0, "query": 0.8},
    "concept": {"entity": 1.2, "concept": 0.8, "source": 1.0, "synthesis": 1.2, "query": 1.0},
    "source": {"entity": 1.0, "concept": 1.0, "source": 0.5, "query": 0.8, "synthesis": 1.0},
    "query": {"concept": 1.0, "entity": 0.8, "synthesis": 1.0, "source": 0.8, "query": 0.5},
    "synthesis": {"concept": 1.2, "entity": 1.0, "source": 1.0, "query": 1.0, "synthesis": 0.8},
}
OTHER_AFFINITY = 0.5


def nodes(pages: DataFrame) -> DataFrame:
    """id, ord, title, type and sources; of pages with one id the last, in listing order."""
    c = F.col("content")
    every = pages.select(F.col("page_id").alias("id"), "ord", fm.title(c, F.col("path")).alias("title"), fm.page_type(c).alias("type"), fm.items(c, "sources").alias("sources"))
    last = every.groupBy("id").agg(F.max(F.struct("ord", "title", "type", "sources")).alias("n"))
    return last.select("id", "n.ord", "n.title", "n.type", "n.sources")


def out_edges(pages: DataFrame) -> DataFrame:
    """Distinct directed edges src, dst between different pages."""
    return resolved(links(pages), pages).where("dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree and their sum, degree; a link both ways counts twice."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def link_counts(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """id and link_count: ends of all links, repeated ones too, to other pages."""
    found = resolved(links(pages), pages) if found is None else found
    each = found.where("dst IS NOT NULL AND src <> dst")
    ends = each.select(F.col("src").alias("id")).unionByName(each.select(F.col("dst").alias("id")))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("link_count"))
    return pages.select(F.col("page_id").alias("id")).join(counted, "id", "left").na.fill(0, ["link_count"])


def undirected_edges(found: DataFrame) -> DataFrame:
    """An edge for each linked pair, in the direction first seen in listing order."""
    each = found.where("dst IS NOT NULL AND src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    first = each.groupBy("a", "b").agg(F.min(F.struct("src_ord", "pos", "src", "dst")).alias("f"))
    return first.select(F.col("f.src").alias("source"), F.col("f.dst").alias("target"))


def affinity(a: Column, b: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for k, row in TYPE_AFFINITY.items() for l, v in row.items() for x in (f"{k}-{l}", v)))
    return F.coalesce(pairs[F.concat_ws("-", a, b)], F.lit(OTHER_AFFINITY))


def neighbours(edges: DataFrame) -> DataFrame:
    """id and n, each neighbour once, whichever way the link goes."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct()


def pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def relevance_of(pairs: DataFrame, graph_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b and relevance of given pairs, a < b.

    Only these pairs are looked at. Common neighbours are looked up from the end with fewer
    neighbours, so a page with very many costs no more than the pages around it.
    """
    pairs = pairs.select("a", "b").distinct()
    direct = edges.select(*pair("src", "dst")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("direct"))
    own = graph_nodes.select("id", "type", "sources")
    known = pairs.join(own.select(F.col("id").alias("a"), F.col("type").alias("ta"), F.col("sources").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("type").alias("tb"), F.col("sources").alias("sb")), "b")
    shared = F.size(F.filter("sb", lambda x: F.array_contains(F.col("sa"), x)))
    degree = degrees(edges).select("id", "degree")
    near = neighbours(edges)
    ends = known.select("a", "b").join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    fewer = ends.select("a", "b", F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("other"))
    both = fewer.join(near, "id").join(near.select(F.col("id").alias("other"), "n"), ["other", "n"], "left_semi")
    weighted = both.join(degree.select(F.col("id").alias("n"), "degree"), "n")
    common = weighted.groupBy("a", "b").agg(F.sum(1.0 / F.log(F.greatest("degree", F.lit(2)).cast("double"))).alias("common"))
    every = known.join(direct, ["a", "b"], "left").join(common, ["a", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = DIRECT * zero("direct") + SHARED_SOURCE * shared + COMMON_NEIGHBOUR * zero("common") + AFFINITY * affinity(F.col("ta"), F.col("tb"))
    return every.select("a", "b", total.alias("relevance"))


def candidates(graph_nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Pairs id, other among which the k most relevant others of each page are.

    They are its neighbours, their neighbours, and of pages that share a source the first
    k + 1 for each type and set of sources: pages with the same set and type are equally relevant
    but for links, so later ones never come before these.
    """
    near = neighbours(edges)
    two = near.join(near.select(F.col("id").alias("n"), F.col("n").alias("other")), "n").select("id", "other")
    groups = graph_nodes.withColumn("own", F.array_sort(F.array_distinct("sources")))
    w = Window.partitionBy("own", "type").orderBy("ord")
    first = groups.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    firsts = first.select(F.col("id").alias("other"), F.explode("own").alias("source"))
    by_source = graph_nodes.select("id", F.explode(F.array_distinct("sources")).alias("source")).join(firsts, "source").select("id", "other")
    found = near.select("id", F.col("n").alias("other")).unionByName(two).unionByName(by_source)
    return found.where("id <> other").distinct()


def related(graph_nodes: DataFrame, edges: DataFrame, k: int = 5, seeds: DataFrame | None = None) -> DataFrame:
    """For each page, or each of seeds (id), its k most relevant others; ties in listing order.

    Pages that share nothing have only the affinity of their types and are left out.
    """
    found = candidates(graph_nodes, edges, k)
    if seeds is not None:
        found = found.join(seeds.select("id"), "id", "left_semi")
    known = relevance_of(found.select(*pair("id", "other")), graph_nodes, edges)
    both = found.withColumn("a", F.least("id", "other")).withColumn("b", F.greatest("id", "other")).join(known, ["a", "b"]).select("id", "other", "relevance")
    placed = both.join(graph_nodes.select(F.col("id").alias("other"), F.col("ord")), "other")
    w = Window.partitionBy("id").orderBy(F.desc(F.round("relevance", 9)), "ord")
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "other", "relevance", "rank")


# Pages of a block, and pairs that share a target for each part of it.
BLOCK, SHARE = 1 << 9, 1 << 21


def common_targets(targets: DataFrame, asked: Column) -> DataFrame:
    """a, b and score of each asked page and every other one that has a target of it, from id and target; asked is a condition on id.

    The score sums 1 / ln(number of pages that have it, 2 at least) over the targets of both, to six places. Pages with the same set
    of targets have the same scores, so blocks of such pages meet in place of pages, at each target of both, and go on at the first;
    pairs of pages are made only as rows of the result, and nothing is grouped by them. Frequent targets are dealt in parts.
    """
    own = stashed(targets.groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("targets")))
    sets = own.groupBy("targets").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked"))
    each = sets.select("key", "targets", "n", "asked", F.explode("targets").alias("target"))
    met = each.groupBy("target").agg(F.sum("n").alias("of"), F.sum("asked").alias("asks")).where("asks > 0")
    pairs, weight = F.col("of") * F.col("asks"), 1.0 / F.log(F.greatest("of", F.lit(2)).cast("double"))
    met = stashed(met.select("target", pairs.alias("pairs"), F.struct(F.monotonically_increasing_id().alias("t"), weight.alias("w"), (1 + F.floor(pairs / SHARE)).alias("parts")).alias("item")))
    tasks = 1 + (met.agg(F.sum("pairs")).first()[0] or 0) // SHARE
    sets = stashed(each.join(met, "target").groupBy("key").agg(F.first("targets").alias("targets"), F.first("n").alias("n"), F.array_sort(F.collect_list("item")).alias("items")))

    def blocks(pages: DataFrame, side: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).alias("block")
        found = pages.join(sets, "targets").groupBy("key", block).agg(F.first("items").alias("items"), F.collect_list("id").alias("ids"))
        each = found.select("*", F.posexplode("items").alias("before", "item"))
        return each.select("key", "block", F.col("ids").alias(f"ids_{side}"), F.col("items").alias(f"items_{side}"), F.slice("items.t", 1, F.col("before")).alias(f"before_{side}"), "item.t", "item.parts")

    a = blocks(own.where(asked), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("key", "block", "parts")
    b = blocks(own, "b").withColumn("part", F.pmod(F.xxhash64("key", "block"), "parts")).withColumn("items_b", F.col("items_b.t")).drop("key", "block", "parts")
    both = a.repartition(tasks, "t", "part").join(b.repartition(tasks, "t", "part"), ["t", "part"]).where(~F.arrays_overlap("before_a", "before_b"))
    score = F.aggregate("items_a", F.lit(0.0), lambda s, x: s + F.when(F.array_contains("items_b", x["t"]), x["w"]).otherwise(0.0))
    scored = both.select("ids_b", F.round(score, 6).alias("score"), F.explode("ids_a").alias("a"))
    return scored.select("a", F.explode("ids_b").alias("b"), "score").where("a <> b")


# Sizes of nodes and widths of edges as drawn.
LEAST_SIZE, MOST_SIZE, LEAST_WIDTH, MORE_WIDTH = 8.0, 28.0, 0.5, 3.5


def drawn(shown: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (link_count) with size, by the root of their share of the most links, and edges (weight) with width, by weight."""
    most = shown.agg(F.greatest(F.max("link_count"), F.lit(1)).alias("most"))
    heaviest = edges.agg(F.greatest(F.max("weight"), F.lit(1.0)).alias("most"))
    size = LEAST_SIZE + F.sqrt(F.col("link_count") / F.col("most")) * (MOST_SIZE - LEAST_SIZE)
    width = LEAST_WIDTH + F.col("weight") / F.col("most") * MORE_WIDTH
    return shown.crossJoin(F.broadcast(most)).withColumn("size", size).drop("most"), edges.crossJoin(F.broadcast(heaviest)).withColumn("width", width).drop("most")


def visual_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type, link_count) without query pages, and edges (source, target, weight) between them."""
    every = nodes(pages)
    shown = every.where("type <> 'query'")
    found = resolved(links(pages), pages)
    alive = shown.select("id")
    own = found.join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi")
    counts = link_counts(pages, own).join(alive, "id", "left_semi")
    edges = undirected_edges(own).withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    weights = relevance_of(edges, every, found.where("dst IS NOT NULL AND src <> dst").select("src", "dst").distinct())
    edges = edges.join(weights, ["a", "b"], "left").select("source", "target", F.coalesce("relevance", F.lit(1.0)).alias("weight"))
    return shown.join(counts, "id").select("id", "ord", F.col("title").alias("label"), "type", "link_count"), edges
