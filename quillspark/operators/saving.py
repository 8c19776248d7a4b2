"""Answers and research as pages: names, page texts, index entries and log lines; templates of projects."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillspark.functions.text import ascii_slug, trimmed, without_thinking

# Project templates and the folders that each adds.
TEMPLATES = {
    "research": ("wiki/methodology", "wiki/findings", "wiki/thesis"),
    "reading": ("wiki/characters", "wiki/themes", "wiki/plot-threads", "wiki/chapters"),
    "personal": ("wiki/goals", "wiki/habits", "wiki/reflections", "wiki/journal"),
    "business": ("wiki/meetings", "wiki/decisions", "wiki/projects", "wiki/stakeholders"),
    "general": (),
}


def slug_of(title: str | None) -> str:
    """Letters, digits and hyphens of any script, at most 50; query if none is left."""
    plain = re.sub(r"\s+", "-", unicodedata.normalize("NFKC", title or "").strip())
    kept = "".join(c for c in plain if c == "-" or unicodedata.category(c)[0] in "LN")
    return re.sub(r"^-|-$", "", re.sub(r"-+", "-", kept)).lower()[:50] or "query"


@pandas_udf(T.StringType())
def query_slug(titles: pd.Series) -> pd.Series:
    return titles.map(slug_of)


def file_name(title: Column, at: Column) -> Column:
    """The slug with date and time."""
    return F.concat(query_slug(title), F.lit("-"), F.date_format(at, "yyyy-MM-dd-HHmmss"), F.lit(".md"))


def _quoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def saved_answers(answers: DataFrame) -> DataFrame:
    """path, content, index_entry and log_line of answers (content, saved_at)."""
    first = trimmed(F.regexp_replace(F.substring_index("content", "\n", 1), "^#+\\s*", ""))
    rows = answers.withColumn("title", F.coalesce(F.nullif(F.substring(first, 1, 60), F.lit("")), F.lit("Saved Query")))
    rows = rows.withColumn("file", file_name(F.col("title"), F.col("saved_at"))).withColumn("day", F.date_format("saved_at", "yyyy-MM-dd"))
    clean = without_thinking(F.regexp_replace("content", "<!--\\s*sources:.*?-->", ""))
    page = F.concat(F.lit('---\ntype: query\ntitle: "'), _quoted(F.col("title")), F.lit('"\ncreated: '), F.col("day"), F.lit("\ntags: []\n---\n"), clean)
    return rows.select(
        F.concat(F.lit("wiki/queries/"), "file").alias("path"),
        page.alias("content"),
        F.concat(F.lit("- [[queries/"), F.regexp_replace("file", "\\.md$", ""), F.lit("|"), F.col("title"), F.lit("]]")).alias("index_entry"),
        F.concat(F.lit("- "), F.col("day"), F.lit(": Saved query page `"), F.col("file"), F.lit("`")).alias("log_line"),
    )


def with_index_entry(index: Column, entry: Column) -> Column:
    """The index with an entry first in its Queries section, which is added if missing."""
    safe = F.replace(F.replace(entry, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    there = F.regexp_replace(index, F.lit("^([\\s\\S]*?## Queries\\n)"), F.concat(F.lit("$1"), safe, F.lit("\n")))
    return F.when(F.contains(index, F.lit("## Queries\n")), there).otherwise(F.concat(F.regexp_replace(index, "\\s+$", ""), F.lit("\n\n## Queries\n"), entry, F.lit("\n")))


def research_topic(title: Column, description: Column) -> Column:
    """The title without what the interface put before it, else the description's first line."""
    plain = trimmed(F.regexp_replace(title, "(?i)^(Save to Wiki|Create|Research)[:\\s]*", ""))
    return F.coalesce(F.nullif(plain, F.lit("")), F.substring_index(description, "\n", 1))


def optimised_topic(answer: Column, fallback: Column) -> Column:
    """topic and at most three queries of a model's answer."""
    topic = F.coalesce(F.nullif(trimmed(F.regexp_extract(answer, "(?m)^TOPIC:[ \\t]*([^\\n]+)$", 1)), F.lit("")), fallback)
    asked = F.slice(F.regexp_extract_all(answer, F.lit("(?m)^QUERY:[ \\t]*([^\\n]+)$"), 1), 1, 3)
    asked = F.filter(F.transform(asked, lambda q: trimmed(q)), lambda q: q != "")
    return F.struct(topic.alias("topic"), F.when(F.size(asked) > 0, asked).otherwise(F.array(topic)).alias("queries"))


def distinct_results(results: DataFrame) -> DataFrame:
    """Web results (task_id, query_pos, pos, title, url, snippet, source) with each url of a task once, the first."""
    w = Window.partitionBy("task_id", "url").orderBy("query_pos", "pos")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def research_pages(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """path and content of finished tasks (task_id, topic, synthesis, saved_at) with their references."""
    w = Window.partitionBy("task_id").orderBy("query_pos", "pos")
    numbered = distinct_results(results).withColumn("n", F.row_number().over(w))
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), "title", F.lit("]("), "url", F.lit(") — "), "source")
    listed = numbered.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("refs"))
    day = F.date_format("saved_at", "yyyy-MM-dd")
    text = reduce(
        lambda a, b: F.concat(a, b),
        (F.lit('---\ntype: query\ntitle: "Research: '), _quoted(F.col("topic")), F.lit('"\ncreated: '), day, F.lit("\norigin: deep-research\ntags: [research]\n---\n\n# Research: "),
         F.col("topic"), F.lit("\n\n"), without_thinking(F.col("synthesis")), F.lit("\n\n## References\n\n"), F.coalesce("refs", F.lit("")), F.lit("\n")),
    )
    path = F.concat(F.lit("wiki/queries/research-"), ascii_slug(F.col("topic")), F.lit("-"), day, F.lit(".md"))
    return tasks.join(listed, "task_id", "left").select("task_id", path.alias("path"), text.alias("content"))


def templates(spark: SparkSession) -> DataFrame:
    """template and the folders that it adds."""
    return spark.createDataFrame([(k, list(v)) for k, v in TEMPLATES.items()], "template string, extra_dirs array<string>")


def registered(projects: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (project_id, name, path, opened_at) after new rows: the latest of each id."""
    every = projects.unionByName(new)
    return every.groupBy("project_id").agg(F.max(F.struct("opened_at", "name", "path")).alias("p")).select("project_id", "p.name", "p.path", "p.opened_at")
