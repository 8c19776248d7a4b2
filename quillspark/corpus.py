"""Adapters that make wiki pages and other inputs of the engine out of plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("entity", "concept", "source", "query", "synthesis")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_count(df: DataFrame) -> DataFrame:
    """df and its number of rows, n."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))


def wiki_pages(docs: DataFrame, sparse: bool = False) -> DataFrame:
    """page_id, ord, path and content of a page for each document, with links by formula."""
    i, n = F.col("doc_id"), F.col("n")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (i % 5 + 1).cast("int"))
    links = F.concat(
        F.lit("\n\n[[doc-"), ((i * 7 + 1) % n).cast("string"),
        F.lit("]] [[Doc "), ((i * 11 + 3) % n).cast("string"),
        F.lit("|see]] [[missing-"), (i % 13).cast("string"), F.lit("]]"),
    )
    if sparse:
        links = F.when(i % 3 == 0, links).otherwise("")
    content = F.concat(
        F.lit("---\ntype: "), kind, F.lit("\ntitle: Doc "), i.cast("string"),
        F.lit('\nsources: ["'), F.col("source"), F.lit('.md"]\n---\n\n# Doc '), i.cast("string"),
        F.lit("\n\n"), F.col("text"), links,
    )
    pages = with_count(docs.select("doc_id", "source", "text"))
    page_id = F.concat(F.lit("doc-"), i.cast("string"))
    return pages.select(page_id.alias("page_id"), i.alias("ord"), F.concat(F.lit("wiki/"), page_id, F.lit(".md")).alias("path"), content.alias("content"))


#: The same in SQL, for comparisons: a common table expression named wiki.
WIKI_SQL = """wiki AS (SELECT 'doc-' || doc_id AS page_id, doc_id AS ord, 'wiki/doc-' || doc_id || '.md' AS path,
 ['entity','concept','source','query','synthesis'][doc_id % 5 + 1] AS type, 'Doc ' || doc_id AS title, source || '.md' AS src,
 '---' || chr(10) || 'type: ' || ['entity','concept','source','query','synthesis'][doc_id % 5 + 1] || chr(10) || 'title: Doc ' || doc_id || chr(10)
 || 'sources: ["' || source || '.md"]' || chr(10) || '---' || chr(10) || chr(10) || '# Doc ' || doc_id || chr(10) || chr(10) || text || {links} AS content
 FROM (SELECT *, count(*) OVER () AS n FROM documents))"""
_LINKS_SQL = "chr(10) || chr(10) || '[[doc-' || ((doc_id * 7 + 1) % n) || ']] [[Doc ' || ((doc_id * 11 + 3) % n) || '|see]] [[missing-' || (doc_id % 13) || ']]'"


def wiki_sql(sparse: bool = False) -> str:
    return WIKI_SQL.format(links=f"CASE WHEN doc_id % 3 = 0 THEN {_LINKS_SQL} ELSE '' END" if sparse else _LINKS_SQL)
