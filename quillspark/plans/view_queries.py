"""Queries of what a viewer shows, over pages made by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import table, wiki_pages, wiki_sql
from quillspark.functions import frontmatter as fm
from quillspark.operators import cascade, viewing
from quillspark.plans.catalog import query

_FOLDERS = ("entities", "concepts", "sources", "queries", "comparisons", "synthesis", "notes")
_FOLDERS_SQL = "[" + ", ".join(f"'{f}'" for f in _FOLDERS) + "]"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below folders; those of odd ids have no front matter."""
    pages = wiki_pages(table(spark, sf_dir, "documents"))
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("ord") % 7 + 1).cast("int"))
    body = fm.body(F.col("content"))
    tagged = F.regexp_replace("content", "\\A---\\n", "---\ntags: [a, \"b c\", 'd']\norigin: web\n")
    return pages.select("page_id", "ord", F.concat(F.lit("wiki/"), folder, F.lit("/"), "page_id", F.lit(".md")).alias("path"), F.when(F.col("ord") % 2 == 1, body).otherwise(tagged).alias("content"))


@query(f"""SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 7 = 6 THEN 'other' ELSE ['entity','concept','source','query','comparison','synthesis'][doc_id % 7 + 1] END
 ELSE ['entity','concept','source','query','synthesis'][doc_id % 5 + 1] END AS type, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'a|b c|d' ELSE '' END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'web' END AS origin FROM documents""")
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, title, tags and origin, with and without front matter."""
    p = _placed(spark, sf_dir).select("ord", viewing.page_info(F.col("content"), F.col("path")).alias("i"))
    return p.select("ord", "i.type", "i.title", F.array_join("i.tags", "|").alias("tags"), "i.origin")


@query("""SELECT doc_id AS ord, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'x|y z' ELSE 'one|two' END AS tags, source || '.md' AS sources FROM documents""")
def front_matter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of the front matter: scalars, and lists inline or as lines."""
    listed = F.when(F.col("ord") % 3 == 0, F.lit("---\ntags: [\"x\", 'y z',]\n")).otherwise(F.lit("---\ntags:\n  - one\n  - \"two\"\n"))
    pages = wiki_pages(table(spark, sf_dir, "documents")).withColumn("content", F.concat(listed, F.substr("content", F.lit(5))))
    p = pages.select("ord", viewing.front_matter(F.col("content")).alias("m"))
    return p.select("ord", F.col("m.scalars")["title"].alias("title"), F.array_join(F.col("m.lists")["tags"], "|").alias("tags"), F.array_join(F.col("m.lists")["sources"], "|").alias("sources"))


@query("""WITH d AS (SELECT doc_id, 'before' || chr(10) || '# One ' || doc_id || chr(10) || text || chr(10) || '## Two' || chr(10) || '### Three' || chr(10) || 'end' AS body FROM documents),
l AS (SELECT doc_id, unnest(string_split_regex(body, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(body, '\\r?\\n'), 1) AS i FROM d),
h AS (SELECT *, regexp_matches(line, '^(#{1,3})\\s+(.+)$') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM h),
g AS (SELECT doc_id, part::INT AS part, coalesce(max(CASE WHEN head THEN trim(regexp_extract(line, '^(#{1,3})\\s+(.+)$', 2)) END), '') AS heading, coalesce(max(CASE WHEN head THEN length(regexp_extract(line, '^(#{1,3})\\s+(.+)$', 1)) END), 0)::INT AS level,
 coalesce(sum(CASE WHEN NOT head THEN length(line) + 1 END), 0)::BIGINT AS n_chars, bool_or(NOT head AND trim(line) <> '') AS filled FROM s GROUP BY 1, 2)
SELECT doc_id, heading, level, n_chars FROM g WHERE filled OR heading <> ''""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents with headings put round them."""
    body = F.concat(F.lit("before\n# One "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n## Two\n### Three\nend"))
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(viewing.sections(body)).alias("s"))
    return s.select("doc_id", "s.heading", "s.level", F.length("s.content").cast("bigint").alias("n_chars"))


@query(f"""WITH p AS (SELECT doc_id AS ord, 'wiki/' || {_FOLDERS_SQL}[doc_id % 7 + 1] || '/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id AS stem FROM documents),
q AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Doc ' || (event_id % 1300) WHEN 1 THEN 'doc-' || (event_id % 1300) WHEN 2 THEN 'oc-' || (event_id % 97) ELSE 'the doc-' || (event_id % 1300) || ' page' END AS name FROM events),
e AS (SELECT id, arg_min(path, ord) AS path FROM q JOIN p ON stem = lower(name) OR stem = regexp_replace(lower(name), '\\s+', '-', 'g') GROUP BY 1),
c AS (SELECT id, arg_min(path, ord) AS path FROM q JOIN p ON contains(stem, lower(name)) OR contains(lower(name), stem) WHERE id NOT IN (SELECT id FROM e) GROUP BY 1)
SELECT * FROM e UNION ALL SELECT * FROM c""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind names: exact ones, slugs, parts and longer ones."""
    i = F.col("event_id")
    d = (i % 1300).cast("string")
    name = F.when(i % 4 == 0, F.concat(F.lit("Doc "), d)).when(i % 4 == 1, F.concat(F.lit("doc-"), d)).when(i % 4 == 2, F.concat(F.lit("oc-"), (i % 97).cast("string"))).otherwise(F.concat(F.lit("the doc-"), d, F.lit(" page")))
    names = table(spark, sf_dir, "events").select(i.alias("id"), name.alias("name"))
    return viewing.pages_of_names(names, _placed(spark, sf_dir).select("path", "ord"))


@query("""WITH l AS (SELECT doc_id, unnest([1, 2, 3]) AS nth, unnest(['doc-' || ((doc_id * 7 + 1) % n), 'Doc ' || ((doc_id * 11 + 3) % n), 'missing-' || (doc_id % 13)]) AS id, unnest(['', 'see', '']) AS shown FROM (SELECT doc_id, count(*) OVER () AS n FROM documents))
SELECT doc_id AS ord, nth::INT AS nth, CASE WHEN shown <> '' THEN shown ELSE id END AS title, 'wiki/entities/' || id || '.md' AS path FROM l""")
def citations_by_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an answer without numbers cites by its links; pages stand for answers."""
    p = wiki_pages(table(spark, sf_dir, "documents")).select("ord", F.posexplode(viewing.linked_citations(F.col("content"))).alias("nth", "c"))
    return p.select("ord", (F.col("nth") + 1).alias("nth"), "c.title", "c.path")


@query(f"""WITH {wiki_sql()}, c AS (SELECT DISTINCT 'wiki/' || (CASE WHEN event_id % 3 = 0 THEN 'concepts/' ELSE '' END) || 'doc-' || (event_id % 1500) || '.md' AS path, event_id % 1500 AS d FROM events)
SELECT c.path, CASE WHEN w.ord IS NULL THEN 0 ELSE w.ord % 4 END::INT AS count, CASE WHEN w.ord % 4 > 0 THEN 'media/' || w.ord || '-0.png' END AS first_url FROM c LEFT JOIN wiki w ON w.ord = c.d""")
def cited_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of cited pages; some citations name a folder where the page isn't."""
    images = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k < F.col("ord") % 4, F.concat(F.lit("\n![x](media/"), F.col("ord").cast("string"), F.lit("-"), k.cast("string"), F.lit(".png)"))).otherwise(""))
    pages = wiki_pages(table(spark, sf_dir, "documents")).select("path", F.concat("content", F.array_join(images, "")).alias("content"))
    e = F.col("event_id")
    path = F.concat(F.lit("wiki/"), F.when(e % 3 == 0, F.lit("concepts/")).otherwise(""), F.lit("doc-"), (e % 1500).cast("string"), F.lit(".md"))
    return viewing.cited_images(table(spark, sf_dir, "events").select(path.alias("path")).distinct(), pages)


@query(f"""WITH f AS (SELECT 'raw/' || source || '/' || {_FOLDERS_SQL}[doc_id % 7 + 1] AS b, source FROM documents)
SELECT b AS folder, count(*)::BIGINT AS n_files FROM f GROUP BY 1 UNION ALL SELECT 'raw/' || source, count(*) FROM f GROUP BY 1 UNION ALL SELECT 'raw', count(*) FROM f""")
def source_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below each folder, at any depth."""
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("raw/"), "source", F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return viewing.folder_counts(table(spark, sf_dir, "documents").select(path.alias("path")))


@query("""SELECT doc_id, 'raw/' || doc_id || ['.md','.PDF','.exe','.tar.gz','','.html'][doc_id % 6 + 1] AS path FROM documents WHERE doc_id % 6 IN (0, 1, 5)""")
def import_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a folder's import takes in."""
    ends = F.element_at(F.array(*map(F.lit, (".md", ".PDF", ".exe", ".tar.gz", "", ".html"))), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), ends).alias("path"))
    return viewing.imported(files)


@query("""WITH w AS (SELECT source, count(*)::BIGINT AS n, count_if(doc_id % 3 < 2)::BIGINT AS e, count_if(doc_id % 5 = 0)::BIGINT AS m, count_if(doc_id % 4 = 0)::BIGINT AS r FROM documents GROUP BY 1)
SELECT source, n AS n_files, e AS n_entities, m AS n_merged, r AS n_reviews, n || ' files written' || CASE WHEN r > 0 THEN ', ' || r || ' review item(s)' ELSE '' END || CASE WHEN m > 0 THEN ' · ' || m || ' entities merged' ELSE '' END AS detail FROM w""")
def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest of each source has written."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    folder = F.element_at(F.array(*map(F.lit, ("entities", "concepts", "sources"))), (F.col("doc_id") % 3 + 1).cast("int"))
    written = d.select("source", F.concat(F.lit("wiki/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    warnings = d.select("source", F.when(F.col("doc_id") % 5 == 0, "x merged into canonical y").otherwise("skipped").alias("warning"))
    return viewing.ingest_statistics(written, warnings, d.where("doc_id % 4 = 0").select("source"))


@query("SELECT conv_id, max(turn)::BIGINT AS updated FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with the latest messages; turns stand for time."""
    return viewing.recent_conversations(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("at")), 20)


@query("""WITH d AS (SELECT *, source = 'src3' AS gone FROM documents)
SELECT 'pages' AS part, count(*)::BIGINT AS n FROM d WHERE NOT gone UNION ALL SELECT 'chunks', 2 * count(*) FROM d WHERE NOT gone
UNION ALL SELECT 'media', count(*) FROM d WHERE NOT gone UNION ALL SELECT 'cache', count(DISTINCT source) FROM d WHERE NOT gone
UNION ALL SELECT 'log: ' || chr(10) || '## [2024-05-06] delete | src3.md' || chr(10) || chr(10) || 'Deleted source file and ' || count(*) || ' wiki pages.' || chr(10), 1 FROM d WHERE gone""")
def source_delete_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of pages, chunks, images and cache after a source goes, and the log's entry."""
    docs = table(spark, sf_dir, "documents")
    pages = wiki_pages(docs)
    chunks = pages.select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    media = docs.select(F.concat(F.lit("wiki/media/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    cache = docs.select(F.concat("source", F.lit(".md")).alias("source")).distinct()
    left = cascade.delete_everywhere(pages, chunks, media, cache, "src3.md", "2024-05-06")
    out = left["log"].select(F.concat(F.lit("log: "), "entry").alias("part"), F.lit(1).cast("bigint").alias("n"))
    for name in ("pages", "chunks", "media", "cache"):
        out = out.unionByName(left[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n"))
    return out
