"""Lexical ranking, its fusion with vector ranks, and what search results show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.functions.frontmatter import title
from quillspark.operators.ranking import ranked
from quillspark.sources.shared import stashed

# Weights of the signals, the constant of rank fusion, and the results shown.
FILENAME_EXACT, PHRASE_IN_TITLE, PHRASE_OCCURRENCE, MOST_OCCURRENCES = 200, 50, 20, 10
TITLE_TOKEN, CONTENT_TOKEN = 5, 1
RRF_K = 60
RESULTS = 20
#: Vector pages whose token ranks are counted; of more, all pages are ranked.
FEW_PAGES = 200


def query_parts(spark: SparkSession, query: str) -> tuple[list[str], str]:
    """Tokens and phrase of one query; without tokens the query is the token."""
    row = spark.range(1).select(text.tokenize(F.lit(query)).alias("t"), text.phrase(F.lit(query)).alias("p")).first()
    return list(row["t"]) or [query.strip().lower()], row["p"]


def _contained(low: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0))


def scored(pages: DataFrame, query: str) -> DataFrame:
    """pages with title, score and title_match, where any signal is there."""
    tokens, phrase = query_parts(pages.sparkSession, query)
    pages = pages.withColumn("title", title(F.col("content"), F.col("path")))
    head = F.lower(F.concat_ws(" ", "title", text.file_name(F.col("path"))))
    low = F.lower("content")
    occ = F.least(text.occurrences(low, F.lit(phrase)), F.lit(MOST_OCCURRENCES)) if phrase else F.lit(0)
    in_title = F.contains(head, F.lit(phrase)) if phrase else F.lit(False)
    exact = F.lower(text.stem(F.col("path"))) == phrase
    title_tokens = _contained(head, tokens)
    score = (
        F.when(exact, FILENAME_EXACT).otherwise(0)
        + F.when(in_title, PHRASE_IN_TITLE).otherwise(0)
        + occ * PHRASE_OCCURRENCE
        + title_tokens * TITLE_TOKEN
        + _contained(low, tokens) * CONTENT_TOKEN
    )
    return pages.withColumn("score", score.cast("bigint")).withColumn("title_match", (title_tokens > 0) | in_title).where("score > 0")


def search_tokens(pages: DataFrame, query: str, limit: int = RESULTS) -> DataFrame:
    """The best pages by lexical score; ties in listing order. Snippets only for those."""
    tokens, phrase = query_parts(pages.sparkSession, query)
    best = scored(pages, query).orderBy(F.desc("score"), "ord").limit(limit)
    low = F.lower("content")
    anchor = F.coalesce(
        *([F.when(F.contains(low, F.lit(phrase)), F.lit(phrase))] if phrase else []),
        *(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in tokens),
        F.lit(query),
    )
    shown = best.withColumn("snippet", text.snippet(F.col("content"), anchor)).withColumn("images", text.image_refs(F.col("content")))
    return shown.select("page_id", "path", "title", "snippet", "title_match", "score", "images", "ord")


def fused(token_ranks: DataFrame, vector_ranks: DataFrame, live: DataFrame, limit: int = RESULTS) -> DataFrame:
    """Reciprocal rank fusion of (page_id, token_rank) and (page_id, vector_rank); best of live pages first."""
    both = token_ranks.join(vector_ranks, "page_id", "full_outer").join(live.select("page_id", "path"), "page_id")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF_K), F.lit(0.0))
    return both.withColumn("score", part("token_rank") + part("vector_rank")).orderBy(F.desc("score"), "path").limit(limit)


def token_ranks(found: DataFrame, others: DataFrame, limit: int) -> DataFrame:
    """page_id and token_rank of the first limit of found (page_id, score, ord), and of those in others (page_id), few.

    The places of a few pages are the numbers of better ones, all counted in one pass; no rank
    of the rest is needed.
    """
    spark = found.sparkSession
    first = found.orderBy(F.desc("score"), "ord").limit(limit).select("page_id", F.row_number().over(Window.orderBy(F.desc("score"), "ord")).cast("bigint").alias("token_rank"))
    few = found.join(F.broadcast(others.select("page_id")), "page_id", "left_semi").collect()
    if not few:
        return first
    better = [F.count_if((F.col("score") > r["score"]) | ((F.col("score") == r["score"]) & (F.col("ord") < r["ord"]))).alias(f"c{k}") for k, r in enumerate(few)]
    counts = found.agg(*better).first()
    return first.unionByName(spark.createDataFrame([(r["page_id"], n + 1) for r, n in zip(few, counts)], "page_id string, token_rank bigint")).distinct()


def search(pages: DataFrame, query: str, vector_pages: DataFrame | None = None, limit: int = RESULTS) -> DataFrame:
    """Token and vector ranks in one plan. vector_pages: page_id and score; up to FEW_PAGES are ranked by counts.

    Beyond the first limit of one kind of rank no page without the other kind can be among the
    first limit of both, so these and the vector pages are enough.
    """
    found = scored(pages, query).select("page_id", "score", "ord")
    if vector_pages is None:
        none = pages.select("page_id", F.lit(None).cast("bigint").alias("vector_rank")).limit(0)
        return fused(token_ranks(found, none, limit), none, pages, limit)
    vectors = ranked(vector_pages, [F.desc("score"), F.col("page_id")], "vector_rank").select("page_id", "vector_rank")
    if vectors.count() > FEW_PAGES:
        return fused(ranked(found, [F.desc("score"), F.col("ord")], "token_rank").select("page_id", "token_rank"), vectors, pages, limit)
    return fused(token_ranks(stashed(found), vectors, limit), vectors, pages, limit)


def image_hits(results: DataFrame) -> DataFrame:
    """Distinct image urls of results (rank, images), of the first result that has each."""
    each = results.select("rank", F.posexplode("images").alias("place", "image")).select("rank", "place", F.col("image.url").alias("url"), F.col("image.alt").alias("alt"))
    return each.groupBy("url").agg(F.min(F.struct("rank", "place", "alt")).alias("first")).select("url", "first.rank", "first.place", "first.alt")
