"""Queries that run streams over whole tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import table
from quillspark.plans.catalog import query
from quillspark.sources.shared import session_dir
from quillspark.streaming import clips, tasks


@query("""
WITH t AS (SELECT *, CASE WHEN doc_id % 8 IN (0, 6) THEN 'cancelled' WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'done' END AS status FROM documents)
SELECT 'p' || (doc_id // 4) AS project_id, 'doc-' || doc_id AS task_id, status,
 (CASE WHEN doc_id % 8 = 0 THEN 1 WHEN doc_id % 8 = 6 THEN 0 WHEN status = 'failed' THEN 3 WHEN doc_id % 7 = 3 THEN 2 ELSE 1 END)::INT AS attempts,
 CASE WHEN status = 'failed' THEN 'unreadable' END AS error, (status = 'done' AND doc_id % 16 <> 5)::INT::BIGINT AS n_pages,
 CASE WHEN status = 'done' AND doc_id % 16 <> 5 THEN length(text) ELSE 0 END::BIGINT AS n_chars FROM t
""")
def queue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a task of the ingest queue, four to a project: what becomes of it, and what tables show of it.

    A first run leaves the first task of each project without a result; some of these, and some that wait,
    are then cancelled. Some tasks fail always, some once. Some are withdrawn after they are done.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = f"{session_dir(spark)}/queue-{uuid.uuid4().hex}"
    inbox, state, checkpoint = (f"{base}/{x}" for x in ("inbox", "state", "checkpoint"))
    i = F.col("doc_id")
    each = docs.select(F.concat(F.lit("p"), F.floor(i / 4).cast("string")).alias("project_id"), F.concat(F.lit("doc-"), i.cast("string")).alias("task_id"), "source", i.alias("at"))

    def told(kind: str, rows: DataFrame) -> None:
        rows.withColumn("kind", F.lit(kind)).write.mode("append").json(inbox)

    def work(todo: DataFrame) -> DataFrame:
        n = F.regexp_extract("task_id", "(\\d+)$", 1).cast("bigint")
        rows = todo.withColumn("doc_id", n).join(docs.select("doc_id", "text"), "doc_id")
        page = F.array(F.struct(F.concat(F.lit("wiki/sources/"), "task_id", F.lit(".md")).alias("path"), F.col("text").alias("content")))
        idle = (i % 7 == 3) & (F.col("attempt") == 1) & (i % 11 != 0)
        return rows.withColumn("files", F.when(~idle & (i % 11 != 0), page)).withColumn("error", F.when(i % 11 == 0, "unreadable"))

    told("add", each)
    tasks.start(tasks.moves(tasks.events(spark, inbox, state)), work, state, checkpoint, every=None).awaitTermination()
    told("cancel", each.where((F.col("at") % 8).isin(0, 6)))
    tasks.drained(spark, inbox, state, checkpoint, work)
    told("withdraw", each.where(F.col("at") % 16 == 5))
    tasks.drained(spark, inbox, state, checkpoint, work)
    seen = tasks.visible(spark, state).groupBy("project_id", "task_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("content").cast("bigint")).alias("n_chars"))
    return tasks.outcomes(spark, state).join(seen, ["project_id", "task_id"], "left").na.fill(0, ["n_pages", "n_chars"]).select("project_id", "task_id", "status", "attempts", "error", "n_pages", "n_chars")


@query("""
WITH c AS (SELECT doc_id, source, 'clip-' || (doc_id % 37) || '-20240506' AS base, doc_id % 2 AS run FROM documents WHERE text <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY run, doc_id) AS n FROM c)
SELECT doc_id, source AS project_id, 'raw/sources/' || base || CASE WHEN n + (n >= 2)::INT > 1 THEN '-' || (n + (n >= 2)::INT) ELSE '' END || '.md' AS path FROM n
""")
def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of web clips made of documents, which come in two runs of a stream; each name's second number is taken before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = f"{session_dir(spark)}/clips-{uuid.uuid4().hex}"
    i = F.col("doc_id")
    title = F.concat(F.lit(" Clip: "), (i % 37).cast("string"), F.lit("!"))
    each = docs.select("doc_id", F.col("source").alias("project_id"), title.alias("title"), F.format_string("u%012d", i).alias("url"), F.col("text").alias("content"), F.lit("2024-05-06T07:08:09Z").alias("clipped"))
    there = docs.select(F.col("source").alias("project_id"), F.explode(F.sequence(F.lit(0), F.lit(36))).alias("k")).distinct()
    there = there.select("project_id", F.concat(F.lit("raw/sources/clip-"), F.col("k").cast("string"), F.lit("-20240506-2.md")).alias("path"))
    for run in (0, 1):
        each.where(i % 2 == run).drop("doc_id").write.mode("append").json(f"{base}/inbox")
        stream = clips.pages(clips.inbox(spark, f"{base}/inbox", 1_000_000), there)
        clips.start(stream, f"{base}/pages", f"{base}/queue", f"{base}/checkpoint", every=None).awaitTermination()
    pages = spark.read.schema(clips.PAGE).option("basePath", f"{base}/pages").parquet(f"{base}/pages")
    return pages.select(F.substring("url", 2, 12).cast("bigint").alias("doc_id"), "project_id", "path")
