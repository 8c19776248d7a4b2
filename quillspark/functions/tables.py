"""Table functions for SQL: chunks, FILE blocks, links and tokens, one row each, for LATERAL joins.

    tables.register(spark)
    spark.sql("SELECT page_id, c.* FROM pages, LATERAL md_chunks(content) c")

What is parsed line by line is a Python table function; links and tokens are SQL
functions, which the optimiser takes into the plan. Null texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillspark.functions import chunk
from quillspark.functions.text import CJK, PUNCTUATION, STOP_WORDS, WHITE
from quillspark.operators.ingest import file_blocks
from quillspark.operators.links import WIKILINK
from quillspark.sources.shipping import shipped


class Chunks:
    """md_chunks(content [, target, most, least, overlap]): the chunks of a page."""

    def eval(self, content: str, target: int = chunk.TARGET, most: int = chunk.MOST, least: int = chunk.LEAST, overlap: int = chunk.OVERLAP):
        for c in chunk.chunk_markdown(content, chunk.Sizes(target, most, least, overlap)) if content is not None else []:
            yield c["index"], c["text"], c["heading_path"], c["char_start"], c["char_end"], c["oversized"]


class FileBlocks:
    """file_blocks(answer): path and content of a model's answer's FILE blocks, then a row for each warning."""

    def eval(self, answer: str):
        found, warnings = file_blocks(answer or "")
        for n, (path, content) in enumerate(found):
            yield n, path, content, None
        for n, w in enumerate(warnings, len(found)):
            yield n, None, None, w


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Pairs of header and body.
SQL_FUNCTIONS = {
    "wikilinks(content STRING) RETURNS TABLE (pos INT, target STRING)": f"""
SELECT pos, regexp_replace(t, {_quoted(f"^[{WHITE}]+|[{WHITE}]+$")}, '')
FROM posexplode(regexp_extract_all(content, {_quoted(WIKILINK)}, 1)) AS l(pos, t)""",
    "query_tokens(query STRING) RETURNS TABLE (pos INT, token STRING)": f"""
SELECT pos, t FROM posexplode(array_distinct(flatten(transform(
  filter(split(lower(query), {_quoted(f"[{PUNCTUATION}]+")}), t -> length(t) > 1 AND NOT array_contains(array({", ".join(map(_quoted, STOP_WORDS))}), t)),
  t -> CASE WHEN t RLIKE {_quoted(f"[{CJK}]")} AND length(t) > 2 THEN concat(
    transform(sequence(1, length(t) - 1), i -> substring(t, i, 2)),
    filter(split(t, ''), c -> c <> '' AND NOT array_contains(array({", ".join(map(_quoted, STOP_WORDS))}), c)), array(t)) ELSE array(t) END)))) AS l(pos, t)""",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    shipped(spark)
    spark.udtf.register("md_chunks", udtf(Chunks, returnType="index int, text string, heading_path string, char_start int, char_end int, oversized boolean"))
    spark.udtf.register("file_blocks", udtf(FileBlocks, returnType="pos int, path string, content string, warning string"))
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
