"""Queries of pages, links, the graph and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import table, wiki_pages, wiki_sql
from quillspark.functions import frontmatter as fm
from quillspark.operators import community, graph, insights, links, lint, viewing
from quillspark.plans.catalog import query

_FM = f"WITH {wiki_sql()}"
_LINKS_SQL = """l AS (SELECT page_id AS src, ord AS src_ord, type, title, UNNEST(regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]', 1)) AS raw,
 generate_subscripts(regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]', 1), 1) - 1 AS pos FROM wiki)"""
_RESOLVED_SQL = _LINKS_SQL + """,
r AS (SELECT l.*, coalesce(a.page_id, b.page_id) AS dst FROM l LEFT JOIN wiki a ON a.page_id = l.raw
 LEFT JOIN wiki b ON lower(b.page_id) = lower(replace(l.raw, ' ', '-')))"""
_EDGES_SQL = _RESOLVED_SQL + """,
e AS (SELECT DISTINCT src, dst FROM r WHERE dst IS NOT NULL AND src <> dst)"""


def _pages(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    return wiki_pages(table(spark, sf_dir, "documents"), sparse)


@query(f"{_FM} SELECT page_id, type, title, src AS sources FROM wiki")
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, title and sources of generated pages."""
    c = F.col("content")
    return _pages(spark, sf_dir).select("page_id", fm.page_type(c).alias("type"), fm.title(c, F.col("path")).alias("title"), F.array_join(fm.items(c, "sources"), ",").alias("sources"))


@query(f"{_FM} SELECT page_id, CASE WHEN lower(src) = 'src3.md' THEN src || ',new.pdf' ELSE src || ',SRC3.md,new.pdf' END AS sources FROM wiki")
def sources_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each page joined by two more, case aside; read back from the page as written."""
    old = fm.sources(F.col("content"))
    new = fm.with_sources(F.col("content"), fm.merged(old, F.array(F.lit("SRC3.md"), F.lit("new.pdf"))))
    return _pages(spark, sf_dir).select("page_id", F.array_join(fm.sources(new), ",").alias("sources"))


@query(f"{_FM}, {_LINKS_SQL} SELECT src AS page_id, pos::INT AS pos, raw AS target FROM l")
def wikilinks_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order."""
    return links.links(_pages(spark, sf_dir)).select(F.col("src").alias("page_id"), "pos", F.col("raw").alias("target"))


@query(f"{_FM}, {_RESOLVED_SQL} SELECT src, pos::INT AS pos, raw, dst FROM r")
def links_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each link, if any."""
    pages = _pages(spark, sf_dir)
    return links.resolved(links.links(pages), pages).select("src", "pos", "raw", "dst")


@query(f"""{_FM}, {_RESOLVED_SQL}, u AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM r WHERE dst IS NOT NULL AND src <> dst),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY src_ord, pos) AS k FROM u) SELECT src AS source, dst AS target FROM f WHERE k = 1""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges in the direction first seen."""
    pages = _pages(spark, sf_dir)
    return graph.undirected_edges(links.resolved(links.links(pages), pages))


@query(f"""{_FM}, {_EDGES_SQL}, d AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e),
n AS (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY 1),
c AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM r WHERE dst IS NOT NULL AND src <> dst UNION ALL SELECT dst FROM r WHERE dst IS NOT NULL AND src <> dst) GROUP BY 1)
SELECT page_id AS id, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(c.n, 0)::BIGINT AS link_count FROM wiki LEFT JOIN n ON n.id = page_id LEFT JOIN c ON c.id = page_id""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct degrees and raw link counts of pages."""
    pages = _pages(spark, sf_dir)
    own = graph.link_counts(pages).join(graph.degrees(graph.out_edges(pages)), "id", "left").na.fill(0, ["out_degree", "in_degree"])
    return own.select("id", "out_degree", "in_degree", "link_count")


_AFFINITY_SQL = "CASE ta || '-' || tb " + " ".join(f"WHEN '{a}-{b}' THEN {v}" for a, row in graph.TYPE_AFFINITY.items() for b, v in row.items()) + " ELSE 0.5 END"
_RELEVANCE_SQL = _EDGES_SQL + f""",
nb AS (SELECT src AS id, dst AS n FROM e UNION SELECT dst, src FROM e),
dg AS (SELECT id AS n, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, 1.0::DOUBLE AS dl, 0.0::DOUBLE AS sh, 0.0::DOUBLE AS cn FROM e
 UNION ALL SELECT x.page_id, y.page_id, 0, 1, 0 FROM wiki x JOIN wiki y ON x.src = y.src AND x.page_id < y.page_id
 UNION ALL SELECT x.id, y.id, 0, 0, 1 / ln(greatest(d, 2)::DOUBLE) FROM nb x JOIN nb y ON x.n = y.n AND x.id < y.id JOIN dg ON dg.n = x.n),
v AS (SELECT a, b, sum(dl) AS dl, sum(sh) AS sh, sum(cn) AS cn FROM g GROUP BY 1, 2),
rel AS (SELECT a, b, 3.0 * dl + 4.0 * sh + 1.5 * cn + {_AFFINITY_SQL} AS relevance FROM (SELECT v.*, x.type AS ta, y.type AS tb FROM v JOIN wiki x ON x.page_id = a JOIN wiki y ON y.page_id = b))"""


@query(f"{_FM}, {_RELEVANCE_SQL} SELECT a, b, round(relevance, 6) AS relevance FROM rel SEMI JOIN (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e) USING (a, b)")
def graph_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of linked pages to each other."""
    pages = _pages(spark, sf_dir)
    edges = graph.out_edges(pages)
    return graph.relevance_of(edges.select(*graph.pair("src", "dst")), graph.nodes(pages), edges).select("a", "b", F.round("relevance", 6).alias("relevance"))


@query(f"""{_FM}, {_RELEVANCE_SQL}, bt AS (SELECT a AS id, b AS other, relevance FROM rel UNION ALL SELECT b, a, relevance FROM rel),
k AS (SELECT id, other, relevance, row_number() OVER (PARTITION BY id ORDER BY round(relevance, 9) DESC, ord) AS rank FROM bt JOIN wiki ON page_id = other)
SELECT id, other, round(relevance, 6) AS relevance, rank::INT AS rank FROM k WHERE rank <= 5""")
def graph_related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most relevant pages of each."""
    pages = _pages(spark, sf_dir)
    found = graph.related(graph.nodes(pages), graph.out_edges(pages), 5)
    return found.select("id", "other", F.round("relevance", 6).alias("relevance"), F.col("rank").cast("int").alias("rank"))


@query("""WITH h AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '<li><a href="/([^"]*)"', 1))) AS slug FROM pages),
d AS (SELECT slug, count(*) AS n FROM h GROUP BY 1)
SELECT x.page_id AS a, y.page_id AS b, round(sum(1 / ln(greatest(n, 2)::DOUBLE)), 6) AS score FROM h x JOIN h y ON x.slug = y.slug AND x.page_id <> y.page_id JOIN d ON d.slug = x.slug WHERE x.page_id % 20 = 0 GROUP BY 1, 2""")
def adamic_adar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth page against all pages, by their common link targets."""
    h = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)"'), 1)).alias("target"))
    return graph.common_targets(h.select("id", F.lower("target").alias("target")), F.col("id") % 20 == 0)


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The visual graph with fixed communities, ord % 7."""
    nodes, edges = graph.visual_graph(_pages(spark, sf_dir))
    return nodes.withColumn("community", (F.col("ord") % 7).cast("int")), edges


_VISUAL_SQL = _RELEVANCE_SQL + """,
vr AS (SELECT r.* FROM r JOIN wiki s ON s.page_id = r.src JOIN wiki t ON t.page_id = r.dst WHERE r.src <> r.dst AND s.type <> 'query' AND t.type <> 'query'),
lc AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM vr UNION ALL SELECT dst FROM vr) GROUP BY 1),
nd AS (SELECT page_id AS id, ord, title AS label, type, coalesce(lc.n, 0)::BIGINT AS link_count, (ord % 7)::INT AS community FROM wiki LEFT JOIN lc ON lc.id = page_id WHERE type <> 'query'),
ve AS (SELECT source, target, coalesce(relevance, 1) AS weight FROM (SELECT src AS source, dst AS target, least(src, dst) AS a, greatest(src, dst) AS b,
 row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src_ord, pos) AS k FROM vr) LEFT JOIN rel USING (a, b) WHERE k = 1)"""


@query(f"{_FM}, {_VISUAL_SQL} SELECT source, target, round(weight, 6) AS weight FROM ve")
def visual_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges of the graph without query pages."""
    return graph.visual_graph(_pages(spark, sf_dir))[1].select("source", "target", F.round("weight", 6).alias("weight"))


@query(f"{_FM}, {_VISUAL_SQL} SELECT id, label, type, link_count FROM nd")
def visual_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph without query pages."""
    return graph.visual_graph(_pages(spark, sf_dir))[0].select("id", "label", "type", "link_count")


@query(f"""{_FM}, {_VISUAL_SQL}, sz AS (SELECT community, count(*) AS node_count, list(label ORDER BY link_count DESC, ord)[1:5] AS top FROM nd GROUP BY 1),
ins AS (SELECT s.community, count(*) AS n FROM ve JOIN nd s ON s.id = source JOIN nd t ON t.id = target WHERE s.community = t.community GROUP BY 1)
SELECT community, node_count::BIGINT AS node_count, coalesce(n, 0)::BIGINT AS intra_edges, round(coalesce(n, 0) / greatest(1.0, node_count * (node_count - 1) / 2.0), 6) AS cohesion, array_to_string(top, ',') AS top_nodes FROM sz LEFT JOIN ins USING (community)""")
def community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, cohesion and top pages of fixed communities."""
    nodes, edges = _labelled(spark, sf_dir)
    s = community.statistics(nodes, edges)
    return s.select("community", "node_count", "intra_edges", F.round("cohesion", 6).alias("cohesion"), F.array_join("top_nodes", ",").alias("top_nodes"))


_LPA_SQL = """,
bo AS MATERIALIZED (SELECT source AS id, target AS n, weight FROM ve UNION ALL SELECT target, source, weight FROM ve),
ow AS MATERIALIZED (SELECT id, max(weight) AS weight FROM bo GROUP BY 1),
lab(k, id, label) AS (SELECT 0, id, id FROM nd UNION ALL
 SELECT l.k + 1, l.id, coalesce(b.label, l.label) FROM lab l LEFT JOIN (
  SELECT id, arg_min(label, {'w': -w, 'label': label}) AS label FROM (
   SELECT id, label, round(sum(weight), 9) AS w FROM (SELECT bo.id, x.label, bo.weight FROM bo JOIN lab x ON x.id = bo.n UNION ALL SELECT x.id, x.label, ow.weight FROM lab x JOIN ow ON ow.id = x.id) GROUP BY 1, 2) GROUP BY 1) b ON b.id = l.id WHERE l.k < 10)
SELECT id, label AS community FROM lab WHERE k = 10"""


@query(f"{_FM}, {_VISUAL_SQL}{_LPA_SQL}".replace("WITH ", "WITH RECURSIVE ", 1))
def communities_lpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by deterministic label propagation."""
    nodes, edges = graph.visual_graph(_pages(spark, sf_dir))
    return community.label_propagation(nodes, edges)


@query()
def communities_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by deterministic local moves, largest first."""
    nodes, edges = graph.visual_graph(_pages(spark, sf_dir))
    labelled = nodes.join(community.louvain(nodes, edges), "id")
    numbered = community.renumbered(community.statistics(labelled, edges)).select("community", F.col("number"))
    return labelled.join(numbered, "community").select("id", "community", "number")


@query(f"""{_FM}, {_VISUAL_SQL}, mx AS (SELECT greatest(1, max(link_count)) AS m FROM nd),
p AS (SELECT ve.*, s.community <> t.community AS c1, s.type <> t.type AND (s.type || '-' || t.type) IN ('source-concept','concept-source','source-synthesis','synthesis-source','query-entity','entity-query') AS c2,
 s.type <> t.type AS c3, least(s.link_count, t.link_count) <= 2 AND greatest(s.link_count, t.link_count) >= m * 0.5 AS c4, weight > 0 AND weight < 2 AS c5 FROM ve JOIN nd s ON s.id = source JOIN nd t ON t.id = target, mx),
q AS (SELECT source, target, least(source, target) || ':::' || greatest(source, target) AS key, (CASE WHEN c1 THEN 3 ELSE 0 END + CASE WHEN c2 THEN 2 WHEN c3 THEN 1 ELSE 0 END + CASE WHEN c4 THEN 2 ELSE 0 END + CASE WHEN c5 THEN 1 ELSE 0 END)::BIGINT AS score FROM p)
SELECT source, target, key, score FROM q WHERE score >= 3 ORDER BY score DESC, key LIMIT 5""")
def surprising_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that connect what is far apart."""
    return insights.surprising_connections(*_labelled(spark, sf_dir)).select("source", "target", "key", "score")


@query(f"""{_FM}, {_VISUAL_SQL}, nbc AS (SELECT source AS id, t.community AS c FROM ve JOIN nd t ON t.id = target UNION SELECT target, s.community FROM ve JOIN nd s ON s.id = source),
k AS (SELECT id, count(DISTINCT c)::BIGINT AS n_communities FROM nbc GROUP BY 1) SELECT k.id, n_communities FROM k JOIN nd ON nd.id = k.id WHERE n_communities >= 3 ORDER BY n_communities DESC, ord LIMIT 3""")
def bridge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages between many communities."""
    return insights.bridges(*_labelled(spark, sf_dir))


@query(f"""{_FM}, {_VISUAL_SQL}, sz AS (SELECT community, count(*) AS nc, min(ord) AS first, list(label ORDER BY link_count DESC, ord)[1] AS top FROM nd GROUP BY 1),
ins AS (SELECT s.community, count(*) AS n FROM ve JOIN nd s ON s.id = source JOIN nd t ON t.id = target WHERE s.community = t.community GROUP BY 1),
nbc AS (SELECT source AS id, t.community AS c FROM ve JOIN nd t ON t.id = target UNION SELECT target, s.community FROM ve JOIN nd s ON s.id = source),
k AS (SELECT id, count(DISTINCT c)::BIGINT AS n FROM nbc GROUP BY 1),
al AS (SELECT 'isolated-node' AS kind, count(*) || ' isolated page' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS title, 0 AS a, 0 AS b FROM nd WHERE link_count <= 1 HAVING count(*) > 0),
th AS (SELECT 'sparse-community', 'Sparse cluster: ' || top, 1, first FROM sz LEFT JOIN ins USING (community) WHERE coalesce(n, 0) / greatest(1.0, nc * (nc - 1) / 2.0) < 0.15 AND nc >= 3),
br AS (SELECT 'bridge-node', 'Key bridge: ' || label, 2, -k.n FROM k JOIN nd ON nd.id = k.id WHERE k.n >= 3 ORDER BY k.n DESC, ord LIMIT 3)
SELECT kind, title FROM (SELECT * FROM al UNION ALL SELECT * FROM th UNION ALL SELECT * FROM br) ORDER BY a, b, title LIMIT 8""")
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated pages, thin communities and bridges."""
    nodes, edges = _labelled(spark, sf_dir)
    return insights.knowledge_gaps(nodes, edges, community.statistics(nodes, edges))


_SPARSE = f"WITH {wiki_sql(True)}, {_LINKS_SQL}"


@query(f"{_SPARSE} SELECT page_id FROM wiki WHERE lower(page_id) NOT IN (SELECT lower(raw) FROM l)")
def lint_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no link names."""
    return lint.orphans(_pages(spark, sf_dir, True))


@query(f"{_SPARSE} SELECT page_id FROM wiki WHERE page_id NOT IN (SELECT src FROM l)")
def lint_no_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without links."""
    return lint.no_outlinks(_pages(spark, sf_dir, True))


@query(f"{_SPARSE} SELECT src AS page_id, pos::INT AS pos, raw AS link FROM l WHERE lower(raw) NOT IN (SELECT lower(page_id) FROM wiki)")
def lint_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to no page, each time."""
    return lint.broken_links(_pages(spark, sf_dir, True))


@query(f"{_FM} SELECT type, count(*)::BIGINT AS n_pages, count(DISTINCT src)::BIGINT AS n_sources FROM wiki GROUP BY 1")
def pages_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and sources by type."""
    n = graph.nodes(_pages(spark, sf_dir))
    return n.groupBy("type").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct(F.element_at("sources", 1)).alias("n_sources"))


@query(f"""{_FM}, {_VISUAL_SQL} SELECT 'node' AS kind, id AS a, '' AS b, round(8 + sqrt(link_count / greatest((SELECT max(link_count) FROM nd), 1)) * 20, 6) AS drawn FROM nd
UNION ALL SELECT 'edge', source, target, round(0.5 + weight / greatest((SELECT max(weight) FROM ve), 1) * 3.5, 6) FROM ve""")
def graph_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of nodes and widths of edges of the graph without query pages."""
    shown, edges = graph.drawn(*graph.visual_graph(_pages(spark, sf_dir)))
    return shown.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.round("size", 6).alias("drawn")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.round("width", 6).alias("drawn")))


@query(f"""{_FM} SELECT * FROM (SELECT type, ['Entities','Concepts','Sources','Queries','Synthesis'][list_position(['entity','concept','source','query','synthesis'], type)] AS label,
 [1,2,3,6,4][list_position(['entity','concept','source','query','synthesis'], type)]::INT AS place, count(*)::BIGINT AS n_pages FROM wiki GROUP BY 1) UNION ALL SELECT 'thesis', 'Other', 99, count(*) FROM wiki WHERE ord % 9 = 0""")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages as shown; some pages have a type of their own, and index and log don't count."""
    pages = _pages(spark, sf_dir)
    typed = pages.select("path", "ord", fm.page_type(F.col("content")).alias("type"))
    more = pages.where("ord % 9 = 0").select(F.explode(F.array(F.concat(F.lit("wiki/t/"), "page_id"), F.lit("wiki/index.md"), F.lit("wiki/log.md"))).alias("path"), "ord", F.lit("thesis").alias("type"))
    return viewing.page_groups(typed.unionByName(more))


@query(f"""{_SPARSE}, f AS (SELECT 'no-outlinks' AS kind, page_id FROM wiki WHERE ord % 3 <> 0 UNION ALL SELECT 'broken-link', src FROM l WHERE lower(raw) NOT IN (SELECT lower(page_id) FROM wiki) UNION ALL SELECT 'semantic', page_id FROM wiki WHERE ord % 5 = 0)
SELECT CASE kind WHEN 'no-outlinks' THEN 'suggestion' ELSE 'confirm' END AS type, CASE kind WHEN 'no-outlinks' THEN 'Add cross-references to ' || page_id || '.md' WHEN 'broken-link' THEN 'Fix broken link in ' || page_id || '.md' ELSE repeat('about ' || page_id || ' ', 20)[1:80] END AS title,
 CASE kind WHEN 'semantic' THEN 'a.md,b.md' ELSE page_id || '.md' END AS pages, CASE kind WHEN 'broken-link' THEN 'open:' || page_id || '.md|delete:/p/wiki/' || page_id || '.md|Skip' ELSE 'open:' || page_id || '.md|Skip' END AS actions, count(*)::BIGINT AS n FROM f GROUP BY ALL""")
def lint_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items that findings become."""
    pages = _pages(spark, sf_dir, True)
    found = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.concat("page_id", F.lit(".md")).alias("page"), F.lit("x").alias("detail"), F.lit(None).cast("array<string>").alias("affected_pages"))
    told = pages.where("ord % 5 = 0").select(F.lit("semantic").alias("kind"), F.concat("page_id", F.lit(".md")).alias("page"), F.repeat(F.concat(F.lit("about "), "page_id", F.lit(" ")), 20).alias("detail"), F.array(F.lit("a.md"), F.lit("b.md")).alias("affected_pages"))
    items = lint.review_items(found(lint.no_outlinks(pages), "no-outlinks").unionByName(found(lint.broken_links(pages), "broken-link")).unionByName(told), "/p")
    each = items.select("type", "title", F.array_join("pages", ",").alias("pages"), F.array_join(F.transform("options", lambda o: o["action"]), "|").alias("actions"))
    return each.groupBy("type", "title", "pages", "actions").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_SPARSE}, g AS (SELECT DISTINCT lower(raw) AS k FROM l) SELECT '- [[' || page_id || ']]' AS entry FROM wiki WHERE lower(page_id) NOT IN (SELECT k FROM g) AND ord % 10 <> 3""")
def lint_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that orphans get in the index, which names some already."""
    pages = _pages(spark, sf_dir, True)
    orphans = lint.orphans(pages).select(F.lit("orphan").alias("kind"), F.concat(F.lit("wiki/x/"), "page_id", F.lit(".md")).alias("page"))
    named = pages.where("ord % 10 = 3").select(F.concat(F.lit("- [["), "page_id", F.lit("]]")).alias("entry"))
    return lint.index_entries(orphans).join(named, "entry", "left_anti")
