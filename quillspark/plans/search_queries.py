"""Queries of lexical and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import table, wiki_pages, wiki_sql
from quillspark.functions import text
from quillspark.operators import search, vectors
from quillspark.plans.catalog import query

QUERY = "The thing, inner erth?"
TOKENS = ("thing", "inner", "erth?")
PHRASE = "the thing, inner erth?"

SCORED_SQL = f"""WITH {wiki_sql()},
p AS (SELECT page_id, path, ord, title, content, lower(content) AS low, lower(title || ' ' || page_id || '.md') AS head FROM wiki),
s AS (SELECT *, 50 * contains(head, '{PHRASE}')::BIGINT
 + 20 * least(10, (length(low) - length(replace(low, '{PHRASE}', ''))) // length('{PHRASE}'))
 + 5 * ({' + '.join(f"contains(head, '{t}')::BIGINT" for t in TOKENS)})
 + {' + '.join(f"contains(low, '{t}')::BIGINT" for t in TOKENS)} AS score FROM p)"""


@query(f"""{SCORED_SQL} SELECT page_id, path, title, score, ord FROM s WHERE score > 0 ORDER BY score DESC, ord LIMIT 20""")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pages for a literal query."""
    return search.search_tokens(wiki_pages(table(spark, sf_dir, "documents")), QUERY).select("page_id", "path", "title", "score", "ord")


@query(f"""{SCORED_SQL}, b AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, ord LIMIT 20),
a AS (SELECT *, CASE WHEN contains(low, '{PHRASE}') THEN '{PHRASE}' {' '.join(f"WHEN contains(low, '{t}') THEN '{t}'" for t in TOKENS)} ELSE '{QUERY}' END AS anchor FROM b),
i AS (SELECT *, instr(low, anchor) - 1 AS p0 FROM a),
r AS (SELECT *, greatest(p0 - 80, 0) AS st, least(length(content), p0 + length(anchor) + 80) AS en FROM i)
SELECT page_id, CASE WHEN p0 < 0 THEN replace(substr(content, 1, 160), chr(10), ' ')
 ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || replace(substr(content, st + 1, en - st), chr(10), ' ') || CASE WHEN en < length(content) THEN '...' ELSE '' END END AS snippet FROM r""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the best pages."""
    return search.search_tokens(wiki_pages(table(spark, sf_dir, "documents")), QUERY).select("page_id", "snippet")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS tokens, len(list_distinct_ordered)::BIGINT AS n_tokens FROM (
SELECT item_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (
SELECT item_id, list_filter(string_split_regex(lower(text), '[\\s,，。！？、；：""“”''‘’（）()\\-_/\\\\·~～…]+'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t)) AS l FROM benchmark))""")
def tokenize_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of benchmark texts taken as queries."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.tokenize(F.col("text")).alias("t"))
    return b.select("item_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@query("""SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), ' the ', ''))) // 5)::INT AS n_the, ((length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3)::INT AS n_ing FROM documents""")
def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two phrases in each document."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences(low, F.lit(" the ")).alias("n_the"), text.occurrences(low, F.lit("ing")).alias("n_ing"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat_ws("#", F.floor(F.col("vec_id") / 5).cast("string"), (F.col("vec_id") % 5).cast("string")).alias("chunk_id"),
        F.floor(F.col("vec_id") / 5).cast("string").alias("page_id"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
        F.col("embedding").alias("vector"),
        "vec_id",
    )


_DISTANCE_SQL = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"
_CHUNK_SQL = "(e.vec_id // 5)::VARCHAR || '#' || (e.vec_id % 5)::VARCHAR"


@query(f"""SELECT {_CHUNK_SQL} AS chunk_id, round({_DISTANCE_SQL}, 6) AS distance, round(1 / (1 + {_DISTANCE_SQL}), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DISTANCE_SQL}, 1 LIMIT 30""")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks of one vector."""
    found = vectors.nearest(_rows(spark, sf_dir), _query_vector(spark, sf_dir), 30)
    return found.select("chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM (SELECT q.vec_id AS query_id, {_CHUNK_SQL} AS chunk_id, {_DISTANCE_SQL} AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE_SQL}, {_CHUNK_SQL})::INT AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 10""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks of each twentieth vector."""
    rows = _rows(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vectors.nearest_batch(rows, asked, 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"""WITH s AS (SELECT (e.vec_id // 5)::VARCHAR AS page_id, (e.vec_id % 5)::INT AS chunk_index, 1 / (1 + {_DISTANCE_SQL}) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
g AS (SELECT page_id, max(score) AS top, sum(score) AS total, list(chunk_index ORDER BY score DESC, chunk_index)[1:3] AS best FROM s GROUP BY 1)
SELECT page_id, round(top + least(0.3 * (total - top), greatest(0, 1 - top)), 6) AS score, array_to_string(best, ',') AS chunks FROM g""")
def vector_page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pages from all their chunks."""
    q = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    hits = _rows(spark, sf_dir).withColumn("score", vectors.score(vectors.squared_distance(F.col("vector"), q)))
    rolled = vectors.page_rollup(hits)
    return rolled.select("page_id", F.round("score", 6).alias("score"), F.array_join(F.transform("chunks", lambda c: c["chunk_index"].cast("string")), ",").alias("chunks"))


@query(f"""{SCORED_SQL},
t AS (SELECT page_id, row_number() OVER (ORDER BY score DESC, ord) AS r FROM s WHERE score > 0),
h AS (SELECT 'doc-' || (e.vec_id // 5) AS page_id, {_DISTANCE_SQL} AS d, e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, {_CHUNK_SQL} LIMIT 30),
c AS (SELECT page_id, max(1 / (1 + d)) AS top, sum(1 / (1 + d)) AS total FROM h GROUP BY 1),
v AS (SELECT page_id, row_number() OVER (ORDER BY top + least(0.3 * (total - top), greatest(0, 1 - top)) DESC, page_id) AS r FROM c)
SELECT page_id, round(coalesce(1.0 / (60 + t.r), 0) + coalesce(1.0 / (60 + v.r), 0), 6) AS score
FROM t FULL OUTER JOIN v USING (page_id) JOIN wiki USING (page_id) ORDER BY coalesce(1.0 / (60 + t.r), 0) + coalesce(1.0 / (60 + v.r), 0) DESC, path LIMIT 20""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector ranks fused, in one plan."""
    hits = vectors.nearest(_rows(spark, sf_dir), _query_vector(spark, sf_dir), 30)
    pages = vectors.page_rollup(hits).select(F.concat(F.lit("doc-"), "page_id").alias("page_id"), "score")
    return search.search(wiki_pages(table(spark, sf_dir, "documents")), QUERY, pages).select("page_id", F.round("score", 6).alias("score"))


@query("""WITH old AS (SELECT (vec_id // 5)::VARCHAR AS page_id, (vec_id % 5)::INT AS chunk_index, vec_id FROM embeddings),
kept AS (SELECT page_id || '#' || chunk_index AS chunk_id, page_id, 'chunk ' || vec_id AS chunk_text FROM old WHERE (vec_id // 5) % 3 <> 0),
new AS (SELECT page_id || '#' || chunk_index AS chunk_id, page_id, 'new ' || vec_id AS chunk_text FROM old WHERE (vec_id // 5) % 3 = 0 AND chunk_index < 2)
SELECT * FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) WHERE page_id::BIGINT % 7 <> 0""")
def vector_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third page's rows replaced by its first two, each seventh page's deleted."""
    stored = _rows(spark, sf_dir)
    page = F.col("page_id").cast("bigint")
    batch = stored.where((page % 3 == 0) & (F.col("chunk_index") < 2)).withColumn("chunk_text", F.concat(F.lit("new "), F.col("vec_id").cast("string")))
    after = vectors.upsert(stored, batch)
    return vectors.delete_pages(after, stored.where(page % 7 == 0).select("page_id")).select("chunk_id", "page_id", "chunk_text")


@query("SELECT count(*)::BIGINT AS n_chunks, count(DISTINCT vec_id // 5)::BIGINT AS n_pages FROM embeddings")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and pages of the vector table."""
    return vectors.counts(_rows(spark, sf_dir))
