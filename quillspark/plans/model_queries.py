"""Queries with table functions and with models' stand-ins over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import table, wiki_pages, wiki_sql
from quillspark.functions import tables, text
from quillspark.operators import stored, sweep, vision
from quillspark.plans.catalog import query
from quillspark.sources import websearch

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""WITH {wiki_sql()}, u AS (SELECT page_id, unnest(regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]', 1)) AS target,
 generate_subscripts(regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]', 1), 1) - 1 AS pos FROM wiki) SELECT page_id, pos::INT AS pos, trim(target) AS target FROM u""")
def sql_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page by the table function, as a SQL user asks for them."""
    tables.register(spark)
    return spark.sql("SELECT p.page_id, l.pos, l.target FROM {pages} p, LATERAL wikilinks(p.content) l", pages=wiki_pages(table(spark, sf_dir, "documents")))


@query(f"""WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\\s,，。！？、；：""“”''‘’（）()\\-_/\\\\·~～…]+'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t)) AS l FROM benchmark),
u AS (SELECT item_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM t), f AS (SELECT item_id, token, min(i) AS i FROM u GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INT AS pos, token FROM f""")
def sql_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of benchmark texts taken as queries, by the table function."""
    tables.register(spark)
    return spark.sql("SELECT b.item_id, t.pos, t.token FROM {b} b, LATERAL query_tokens(b.text) t", b=table(spark, sf_dir, "benchmark"))


@query("""SELECT doc_id, 0 AS pos, 'wiki/a/' || doc_id || '.md' AS path, length(text) AS n_chars, NULL AS warning FROM documents
UNION ALL SELECT doc_id, 1, NULL, 0, 'unsafe path: raw/' || doc_id FROM documents UNION ALL SELECT doc_id, 2, NULL, 0, 'unclosed block: wiki/b.md' FROM documents""")
def sql_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILE blocks of answers made of documents, by the table function: one that is taken, and two that only warn."""
    tables.register(spark)
    i = F.col("doc_id").cast("string")
    end = "\n---END FILE---\n"
    answer = F.concat(F.lit("---FILE: wiki/a/"), i, F.lit(".md---\n"), "text", F.lit(f"{end}---FILE: raw/"), i, F.lit(f"---\nx{end}---FILE: wiki/b.md---\nopen"))
    answers = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))
    return spark.sql("SELECT a.doc_id, b.pos, b.path, CAST(coalesce(length(b.content), 0) AS BIGINT) AS n_chars, b.warning FROM {a} a, LATERAL file_blocks(a.answer) b", a=answers)


@query("""WITH q AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS q FROM benchmark)
SELECT item_id, k::INT AS pos, CASE WHEN k = 2 THEN 'Untitled' ELSE q || ' ' || k END AS title, 'https://www.site' || k || '.example/' || lower(regexp_extract(q, '\\S+')) AS url, 'about ' || q AS snippet, 'site' || k || '.example' AS source FROM q, range(3) t(k)""")
def sql_web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web search for the first words of each benchmark text, by the table function, with a transport that needs no network."""
    websearch.register(spark)
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("q"))
    return spark.sql("SELECT a.item_id, r.* FROM {a} a, LATERAL web_search(a.q, 'quillspark.sources.websearch:echoed', 'results', 10) r", a=asked)


def _picture(image: bytes, mime: str, before: str, after: str) -> str:
    name = image.decode()
    if name.endswith("7"):
        raise RuntimeError("the model doesn't answer")
    return f"{name}, {mime}]"


@query("""WITH d AS (SELECT doc_id, doc_id % 50 AS a, (doc_id * 3 + 1) % 50 AS b FROM documents),
i AS (SELECT doc_id, unnest([a, b]) AS k FROM d), s AS (SELECT DISTINCT doc_id, k FROM i)
SELECT 'doc-' || doc_id AS page_id, count_if(k % 4 = 0)::BIGINT AS cached, count_if(k % 4 <> 0 AND k % 10 <> 7)::BIGINT AS fresh, count_if(k % 4 <> 0 AND k % 10 = 7)::BIGINT AS failed,
 (SELECT string_agg('![' || CASE WHEN k % 4 = 0 THEN 'old ' || k WHEN k % 10 = 7 THEN 'x' ELSE 'image ' || k || ', image/png)' END || '](media/' || k || '.png)', '' ORDER BY n)
  FROM (SELECT unnest([d.a, d.b]) AS k, unnest([1, 2]) AS n)) AS images
FROM s JOIN d USING (doc_id) GROUP BY doc_id, d.a, d.b""")
def image_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of two images on each page, of fifty in all: some from the cache, some new, some that the model fails for."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    page_id = F.concat(F.lit("doc-"), i.cast("string")).alias("page_id")
    a, b = (i % 50).cast("string"), ((i * 3 + 1) % 50).cast("string")
    shown = lambda k: F.concat(F.lit("![x](media/"), k, F.lit(".png)"))
    pages = docs.select(page_id, F.concat(F.lit("text "), shown(a), F.lit(" more "), shown(b)).alias("content"))
    both = docs.select(page_id, F.explode(F.array_distinct(F.array(a, b))).alias("k"))
    images = both.select("page_id", F.concat(F.lit("media/"), "k", F.lit(".png")).alias("url"), F.lit("image/png").alias("mime"), F.concat(F.lit("image "), "k").cast("binary").alias("content"))
    k = F.col("id")
    cache = spark.range(0, 50, 4).select(F.sha2(F.concat(F.lit("image "), k.cast("string")).cast("binary"), 256).alias("sha256"), F.concat(F.lit("old "), k.cast("string")).alias("caption"), F.lit("image/png").alias("mime"), F.lit("m").alias("model"), F.lit(None).cast("timestamp").alias("captured_at"))
    got = vision.captions(pages, images, cache, _picture, "stand-in", F.lit("2024-05-06"))
    alone = F.array_join(F.regexp_extract_all("content", F.lit("(!\\[[^\\]]*\\]\\([^)]*\\))"), 1), "")
    return got["pages"].select("page_id", alone.alias("images")).join(got["counts"], "page_id").select("page_id", "cached", "fresh", "failed", "images")


def _read(image: bytes, page: int, total: int) -> str:
    if page == 1 and len(image) % 5 == 0:
        raise RuntimeError("the model doesn't answer")
    return image.decode()


@query("""WITH d AS (SELECT doc_id, text, length(text) // 3 + 1 AS n FROM documents), p AS (SELECT doc_id, k, substr(text, k * n + 1, n) AS part FROM d, range(3) t(k)),
g AS (SELECT doc_id, string_agg('<!-- Page ' || (k + 1) || ' -->' || chr(10) || regexp_replace(part, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY k) AS text FROM p WHERE NOT (k = 1 AND strlen(part) % 5 = 0) AND regexp_replace(part, '\\s+', '', 'g') <> '' GROUP BY 1)
SELECT doc_id, coalesce(g.text, '(OCR 未能提取到任何文字 — 请确认视觉模型已正确配置)') AS text FROM documents LEFT JOIN g USING (doc_id)""")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of scanned files, three pages of each document, by a reader that fails for some second pages."""
    n = (F.floor(F.length("text") / 3) + 1).cast("int")
    pages = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.base64(F.substr("text", k * n + 1, n).cast("binary")))
    payload = F.to_json(F.struct(F.lit("image_pages").alias("type"), F.lit(3).alias("page_count"), F.lit(150).alias("dpi"), pages.alias("pages")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit(vision.MARKER), payload).alias("content"))
    return vision.scanned_texts(files, _read, 8).select(F.col("path").cast("bigint").alias("doc_id"), "text")


def _judge(asked: str) -> str:
    ids = [line.split("=", 1)[1].split(" ", 1)[0] for line in asked.split("\n") if line.startswith("- id=")]
    return "So: " + str({"resolved": [i for i in ids if int(i) % 30 == 7]}).replace("'", '"')


@query("""WITH r AS (SELECT event_id, user_id % 25 AS p, (row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) - 1) // 40 AS b FROM events WHERE event_id % 11 <> 0),
s AS (SELECT p, b, count(*) AS n, count_if(event_id % 30 = 7) AS k FROM r WHERE b < 5 GROUP BY 1, 2),
a AS (SELECT *, coalesce(min(k) OVER (PARTITION BY p ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM s)
SELECT 'p' || p AS project_id, b::INT AS batch, n::INT AS n_items, k::INT AS n_resolved FROM a WHERE before > 0""")
def review_judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of pending items that a judge is asked about, by project, until one resolves nothing."""
    i = F.col("event_id")
    project = F.concat(F.lit("p"), (F.col("user_id") % 25).cast("string")).alias("project_id")
    items = table(spark, sf_dir, "events").where(i % 11 != 0).select(project, i.cast("string").alias("id"), F.lit("confirm").alias("type"), F.concat(F.lit("Item "), i.cast("string")).alias("title"), F.lit("about").alias("description"), F.array(F.lit("a.md")).alias("pages"), i.alias("created_at"))
    pages = wiki_pages(table(spark, sf_dir, "documents")).select(F.concat(F.lit("p"), (F.col("ord") % 25).cast("string")).alias("project_id"), "ord", "page_id", F.lit("T").alias("title"))
    return sweep.asked(items, pages, _judge).select("project_id", "batch", "n_items", F.size("resolved").alias("n_resolved"))


@query("""SELECT 'p' || conv_id AS project_id, ['split', 'combined', 'flat'][conv_id % 3 + 1] AS layout, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos,
 CASE WHEN conv_id % 3 = 2 THEN 'default' ELSE 'c' || conv_id END AS conversation_id, CASE WHEN conv_id % 3 = 2 THEN 'Previous Conversations' ELSE 'Talk ' || conv_id END AS title,
 (CASE WHEN conv_id % 3 = 2 THEN max(turn) OVER (PARTITION BY conv_id) ELSE 9 END)::BIGINT AS updated, role, text AS content FROM conversations""")
def stored_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read from files of all three layouts, a project each."""
    talks = table(spark, sf_dir, "conversations")
    c = F.col("conv_id").cast("string")
    message = F.struct(F.col("turn").cast("string").alias("id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp"), F.concat(F.lit("c"), c).alias("conversationId"))
    each = talks.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("m"))
    listed = F.array(F.struct(F.concat(F.lit("c"), c).alias("id"), F.concat(F.lit("Talk "), c).alias("title"), F.lit(1).alias("createdAt"), F.lit(9).alias("updatedAt")))
    file = lambda path, value: F.struct(path.alias("path"), F.to_json(value).alias("text"))
    split = F.array(file(F.lit("conversations.json"), listed), file(F.concat(F.lit("chats/c"), c, F.lit(".json")), F.col("m")), F.struct(F.lit("chats/gone.json").alias("path"), F.lit("[{").alias("text")))
    combined = F.array(file(F.lit("chat-history.json"), F.struct(listed.alias("conversations"), F.col("m").alias("messages"))), F.struct(F.lit("conversations.json").alias("path"), F.lit("not json").alias("text")))
    flat = F.array(file(F.lit("chat-history.json"), F.col("m")))
    kind = F.col("conv_id") % 3
    files = each.select(F.concat(F.lit("p"), c).alias("project_id"), F.explode(F.when(kind == 0, split).when(kind == 1, combined).otherwise(flat)).alias("f")).select("project_id", "f.*")
    got = stored.chats(files)
    about = got["conversations"].select("project_id", F.col("id").alias("conversation_id"), "title", F.col("updatedAt").alias("updated"))
    return got["messages"].withColumnRenamed("conversationId", "conversation_id").join(about, ["project_id", "conversation_id"]).select("project_id", "layout", "pos", "conversation_id", "title", "updated", "role", "content")
