"""Queries of ingest, reviews, context, conversations, languages, HTML and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import table, wiki_pages, wiki_sql
from quillspark.functions import chunk, language, text
from quillspark.functions import frontmatter as fm
from quillspark.operators import cascade, chat, context, ingest, overlap, reviews, search
from quillspark.plans.catalog import query
from quillspark.plans.search_queries import PHRASE, SCORED_SQL, TOKENS
from quillspark.sources import files, html
from quillspark.streaming import windows


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki_pages(table(spark, sf_dir, "documents"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items from events: type, title and place in time by formula."""
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("missing-page", "duplicate", "contradiction", "suggestion", "confirm")))
    heads = F.array(*map(F.lit, ("Missing page: ", "Duplicate page: ", "")))
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.element_at(kinds, (i % 5 + 1).cast("int")).alias("type"),
        F.concat(F.element_at(heads, (i % 3 + 1).cast("int")), F.lit("Doc "), (i % 1400).cast("string")).alias("title"),
        F.concat(F.lit("about "), i.cast("string")).alias("description"),
        F.lit(None).cast("string").alias("source_path"),
        F.array(F.concat(F.lit("wiki/doc-"), (i % 1700).cast("string"), F.lit(".md"))).alias("pages"),
        F.array(F.concat(F.lit("q"), (i % 3).cast("string"))).alias("queries"),
        (i % 11 == 0).alias("resolved"),
        i.alias("created_at"),
    )


_REVIEWS_SQL = """rv AS (SELECT event_id AS id, ['missing-page','duplicate','contradiction','suggestion','confirm'][event_id % 5 + 1] AS type,
 'doc ' || (event_id % 1400) AS key, 'doc-' || (event_id % 1700) AS page, event_id % 11 = 0 AS resolved FROM events)"""


@query(f"""WITH {_REVIEWS_SQL} SELECT min(id) AS id, type, key, 'about ' || max(id) AS description, count(*)::BIGINT AS n_merged, count(DISTINCT page)::BIGINT AS n_pages, count(DISTINCT id % 3)::BIGINT AS n_queries FROM rv WHERE NOT resolved GROUP BY type, key""")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending items of one type and title as one."""
    m = reviews.merged(_reviews(spark, sf_dir))
    return m.select("id", "type", "key", "description", "n_merged", F.size("pages").cast("bigint").alias("n_pages"), F.size("queries").cast("bigint").alias("n_queries"))


@query(f"""WITH {wiki_sql()}, {_REVIEWS_SQL}
SELECT id, 'page-exists' AS action FROM rv WHERE NOT resolved AND type = 'missing-page' AND (key IN (SELECT lower(title) FROM wiki) OR replace(key, ' ', '-') IN (SELECT page_id FROM wiki) OR page IN (SELECT page_id FROM wiki))
UNION ALL SELECT id, 'page-gone' FROM rv WHERE NOT resolved AND type = 'duplicate' AND page NOT IN (SELECT page_id FROM wiki)""")
def review_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the pages resolve."""
    pages = _pages(spark, sf_dir).select("page_id", fm.title(F.col("content"), F.col("path")).alias("title"))
    return reviews.swept(_reviews(spark, sf_dir), pages)


_NAMES = ("Ac {}", "acme-{}", "Acme_{} Ltd", "The Acme {} Holding Company")


@query(f"""WITH n AS (SELECT s_suppkey AS id, regexp_replace(lower(replace([{', '.join(f"'{n}'" for n in _NAMES)}][s_suppkey // 2 % 4 + 1], '{{}}', (s_suppkey % 97)::VARCHAR)), '[\\s_\\-·•]', '', 'g') AS name FROM supplier),
x AS (SELECT id, name AS na FROM n WHERE id % 2 = 1), y AS (SELECT id AS known_id, name AS nb FROM n WHERE id % 2 = 0),
m AS (SELECT id, known_id FROM x, y WHERE na = nb OR (length(na) >= 2 AND length(nb) >= 2 AND (contains(na, nb) OR contains(nb, na)))
 OR (greatest(length(na), length(nb)) <= 8 AND levenshtein(na, nb) <= 1) OR (greatest(length(na), length(nb)) <= 12 AND levenshtein(na, nb) <= 2))
SELECT id, min(known_id) AS known_id FROM m GROUP BY 1""")
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first similar name among those of even suppliers, for each odd one; names of four forms, by formula."""
    key = F.col("s_suppkey")
    name = F.replace(F.element_at(F.array(*map(F.lit, _NAMES)), (F.floor(key / 2) % 4 + 1).cast("int")), F.lit("{}"), (key % 97).cast("string"))
    s = table(spark, sf_dir, "supplier").select(key.alias("id"), text.normalize_name(name).alias("name"))
    known = s.where("id % 2 = 0").select(F.col("id").alias("known_id"), F.col("name").alias("known_name"), F.col("id").alias("ord"))
    return ingest.name_matches(s.where("id % 2 = 1"), known)


@query(f"""WITH {wiki_sql()} SELECT page_id, CASE WHEN src <> 'src3.md' THEN 'skip' WHEN ord % 2 = 0 THEN 'keep' ELSE 'delete' END AS action,
CASE WHEN src <> 'src3.md' THEN src || CASE WHEN ord % 2 = 0 THEN ',extra.pdf' ELSE '' END WHEN ord % 2 = 0 THEN 'extra.pdf' ELSE '' END AS survivors FROM wiki""")
def source_delete_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of pages when one source goes; even pages have one more."""
    own = fm.sources(F.col("content"))
    both = F.when(F.col("ord") % 2 == 0, F.concat(own, F.array(F.lit("extra.pdf")))).otherwise(own)
    f = cascade.fate(both, F.lit("SRC3.md"))
    return _pages(spark, sf_dir).select("page_id", f.alias("f")).select("page_id", "f.action", F.array_join("f.survivors", ",").alias("survivors"))


@query(f"""WITH {wiki_sql()}, d AS (SELECT page_id FROM wiki WHERE src = 'src3.md')
SELECT w.page_id, CASE WHEN w.page_id IN (SELECT page_id FROM d) THEN 'delete' ELSE 'relink' END AS action FROM (SELECT *, (ord * 7 + 1) % (SELECT count(*) FROM wiki) AS l1, (ord * 11 + 3) % (SELECT count(*) FROM wiki) AS l2 FROM wiki) w
WHERE w.page_id IN (SELECT page_id FROM d) OR 'doc-' || l1 IN (SELECT page_id FROM d) OR 'doc-' || l2 IN (SELECT page_id FROM d)""")
def dead_link_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that deleting a source removes or changes."""
    return cascade.delete_source(_pages(spark, sf_dir), "src3.md").select("page_id", "action")


@query("""WITH c AS (SELECT doc_id, sha256(text) AS hash FROM documents),
p AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS old FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id::VARCHAR AS source, hash, CASE WHEN old IS NULL THEN 'new' WHEN old = hash AND doc_id % 9 <> 0 THEN 'hit' ELSE 'changed' END AS status FROM c LEFT JOIN p USING (doc_id)""")
def ingest_cache_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a cache that lacks some, has old hashes of some and lost the files of some."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("source"), "text")
    cached = d.where("doc_id % 4 <> 0").select(
        "source",
        F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"),
        F.array(F.concat(F.lit("wiki/"), "source")).alias("files_written"),
    )
    files = d.where("doc_id % 9 <> 0").select(F.concat(F.lit("wiki/"), "source").alias("path"))
    return ingest.cache_status(d.select("source", F.sha2("text", 256).alias("hash")), cached, files)


@query("""SELECT doc_id, k::INT AS chunk_index, (k * 800)::INT AS char_start, substr(text, k * 800 + 1, 1000) AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0)::INT, 1))) AS k FROM documents)""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of plain texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunk.fixed_windows(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.chunk_index", "c.char_start", "c.text")


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of generated pages."""
    return chunk.chunks(_pages(spark, sf_dir))


def _language_sql() -> str:
    has = lambda words: f"regexp_matches(low, '\\b({words})\\b')"
    cases = []
    for name, marks, words, how, also, also_marks in language.LATIN:
        tests = ([f"regexp_matches(low, '[{marks}]')"] if marks else []) + ([has(words)] if words else [])
        rule = f" {how.upper()} ".join(tests)
        besides = ([has(also)] if also else []) + ([f"regexp_matches(low, '[{also_marks}]')"] if also_marks else [])
        cases.append(f"WHEN ({rule}){' AND (' + ' OR '.join(besides) + ')' if besides else ''} THEN '{name}'")
    return "CASE " + " ".join(cases) + " ELSE 'English' END"


@query(f"SELECT doc_id, {_language_sql()} AS detected FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; none has a script but Latin."""
    return table(spark, sf_dir, "documents").select("doc_id", language.detect(F.col("text")).alias("detected"))


@query(f"SELECT lang, detected, count(*)::BIGINT AS n FROM (SELECT lang, {_language_sql()} AS detected FROM (SELECT lang, lower(text) AS low FROM documents)) GROUP BY 1, 2")
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given and detected languages."""
    d = table(spark, sf_dir, "documents").select("lang", language.detect(F.col("text")).alias("detected"))
    return d.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


_STRIP_SQL = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer|noscript)\b.*?</(script|style|nav|header|footer|noscript)\s*>', '', 'g'), '(?is)<!--.*?-->', '', 'g'), '(?is)<(div|section|aside)[^>]*class="[^"]*\b(sidebar|ad|ads|comments)\b[^"]*"[^>]*>.*?</(div|section|aside)>', '', 'g')"""


@query(rf"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(regexp_replace(regexp_replace({_STRIP_SQL}, '(?is)<title\b.*?</title>', '', 'g'), '<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM pages""")
def html_fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of pages by patterns alone."""
    return table(spark, sf_dir, "pages").select("page_id", html.fallback_text(F.col("html"), most=None).alias("text"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages."""
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main content of pages as markdown, by scoring."""
    return html.main_markdown(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("""SELECT n, greatest(CASE WHEN n > 0 THEN n ELSE 204800 END, 0)::BIGINT AS max_ctx, floor((CASE WHEN n > 0 THEN n ELSE 204800 END) * 0.15)::BIGINT AS response_reserve,
floor((CASE WHEN n > 0 THEN n ELSE 204800 END) * 0.05)::BIGINT AS index_budget, floor((CASE WHEN n > 0 THEN n ELSE 204800 END) * 0.5)::BIGINT AS page_budget,
least(floor((CASE WHEN n > 0 THEN n ELSE 204800 END) * 0.5), greatest(5000, floor(floor((CASE WHEN n > 0 THEN n ELSE 204800 END) * 0.5) * 0.3)))::BIGINT AS max_page_size FROM (SELECT DISTINCT n_chars * 100 AS n FROM documents)""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets for many context sizes."""
    n = table(spark, sf_dir, "documents").select((F.col("n_chars") * 100).alias("n")).distinct()
    return n.select("n", context.budget(F.col("n")).alias("b")).select("n", "b.*")


_CUT_SQL = "chr(10) || chr(10) || '[...truncated...]'"


@query(f"""{SCORED_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
b AS (SELECT *, CASE WHEN contains(head, '{PHRASE}') OR {' OR '.join(f"contains(head, '{t}')" for t in TOKENS)} THEN 0 ELSE 1 END AS priority FROM s WHERE score > 0 ORDER BY score DESC, ord LIMIT 20),
o AS MATERIALIZED (SELECT page_id, priority, length(CASE WHEN length(content) > 5000 THEN substr(content, 1, 5000) || {_CUT_SQL} ELSE content END)::INT AS n, row_number() OVER (ORDER BY priority, score DESC, ord) AS r FROM b),
f(r, used, kept, fits) AS (SELECT 0::BIGINT, 0, 0, false UNION ALL
 SELECT o.r, CASE WHEN f.used < 40000 AND f.used + o.n <= 40000 THEN f.used + o.n ELSE f.used END, f.kept + (f.used < 40000 AND f.used + o.n <= 40000)::INT, f.used < 40000 AND f.used + o.n <= 40000 FROM f JOIN o ON o.r = f.r + 1)
SELECT 0::BIGINT AS query_id, page_id, priority::INT AS priority, kept::INT AS position, n AS n_chars FROM f JOIN o USING (r) WHERE fits""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pages of a query as far as they fit."""
    pages = _pages(spark, sf_dir)
    best = search.search_tokens(pages, "The thing, inner erth?")
    rows = best.join(pages.select("page_id", "content"), "page_id")
    place = (F.lit(10_000) - F.col("score")) * 1_000_000 + F.col("ord")
    given = rows.select(F.lit(0).cast("bigint").alias("query_id"), "page_id", F.when(F.col("title_match"), 0).otherwise(1).alias("priority"), place.alias("place"), "content")
    return context.packed(given, 40_000, 5_000).drop("content")


_TRIMMED_SQL = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')"


@query(f"SELECT conv_id, turn, role FROM ({_TRIMMED_SQL}) WHERE r <= 4")
def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation."""
    return chat.history(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


@query("SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1) m USING (conv_id) WHERE NOT (c.turn = m.t AND c.role = 'assistant')")
def chat_regenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without their last answer."""
    return chat.without_last_answer(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, substr(arg_min(text, turn), 1, 50) AS title FROM conversations WHERE role = 'user' GROUP BY 1")
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of conversations."""
    return chat.titles(table(spark, sf_dir, "conversations"))


@query("SELECT lang, count(*)::BIGINT AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic, round(avg(quality), 6) AS quality_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.round(F.avg("quality"), 6).alias("quality_rate"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM documents), b AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM d JOIN t USING (g) GROUP BY 1, 2""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share runs of eight words with benchmark items."""
    return overlap.shared_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT ['pending','processing','done','failed'][event_id % 4 + 1] AS status, count(*)::BIGINT AS n, count_if(event_id % 3 = 0)::BIGINT AS n_retried FROM events GROUP BY 1")
def queue_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a queue by status."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("n_retried"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    w = windows.tumbling(table(spark, sf_dir, "events"), "1 hour", "event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, apart by half an hour."""
    w = windows.sessions(table(spark, sf_dir, "events"), "30 minutes", "user_id")
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH f AS (SELECT doc_id, ['a/b.TS','C:\\x\\y.py','/p/wiki/é.yml','raw/.hidden','noext','//srv/s.Weird'][doc_id % 6 + 1] AS path FROM documents)
SELECT doc_id, ['typescript','python','yaml','hidden','noext','weird'][doc_id % 6 + 1] AS language, ['p/a/b.TS','p/C:/x/y.py','p/p/wiki/é.yml','p/raw/.hidden','p/noext','p/srv/s.Weird'][doc_id % 6 + 1] AS joined,
 ['a/b.TS','C:/x/y.py','wiki/é.yml','raw/.hidden','noext','//srv/s.Weird'][doc_id % 6 + 1] AS relative, (doc_id % 6 IN (1, 2, 5)) AS absolute, ['b','y','é','.hidden','noext','s'][doc_id % 6 + 1] AS stem FROM f""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, joins and relatives of paths of several systems."""
    paths = F.array(*map(F.lit, ("a/b.TS", "C:\\x\\y.py", "/p/wiki/é.yml", "raw/.hidden", "noext", "//srv/s.Weird")))
    p = F.element_at(paths, (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", files.code_language(p).alias("language"), text.join_path(F.lit("p"), p).alias("joined"), text.relative_path(p, F.lit("/p/")).alias("relative"), text.is_absolute_path(p).alias("absolute"), text.stem(p).alias("stem")
    )
