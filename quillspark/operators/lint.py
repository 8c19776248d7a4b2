"""Structural checks of linked pages, and the parser of a model's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import trimmed
from quillspark.operators.links import lint_keys, links


def _checked(pages: DataFrame) -> DataFrame:
    """Pages but for index and log, by file name."""
    return pages.where(~F.regexp_extract("path", "([^/]+)$", 1).isin("index.md", "log.md"))


def resolved(pages: DataFrame) -> DataFrame:
    """Links with the page of their key, by path or base name, any case."""
    found = links(pages).withColumn("key", F.lower("raw"))
    return found.join(lint_keys(pages), "key", "left")


def orphans(pages: DataFrame) -> DataFrame:
    """Pages that no link names by its key; a page's own link counts."""
    inbound = resolved(pages).where("dst IS NOT NULL").select(F.col("dst").alias("page_id")).distinct()
    return _checked(pages).select("page_id").join(inbound, "page_id", "left_anti")


def no_outlinks(pages: DataFrame) -> DataFrame:
    return _checked(pages).join(links(pages).select(F.col("src").alias("page_id")).distinct(), "page_id", "left_anti").select("page_id")


def broken_links(pages: DataFrame) -> DataFrame:
    """A row for each link whose key and whose key's base name no page has."""
    keys = lint_keys(pages).select("key")
    own = links(_checked(pages)).withColumn("key", F.lower("raw")).withColumn("base", F.lower(F.substring_index("raw", "/", -1)))
    return own.join(keys, "key", "left_anti").join(keys.withColumnRenamed("key", "base"), "base", "left_anti").select(F.col("src").alias("page_id"), "pos", F.col("raw").alias("link"))


def semantic(answer: Column) -> Column:
    """Structs of kind, severity, title, pages and detail, from a model's LINT blocks."""
    pattern = F.lit("(?s)---LINT:\\s*([^\\n|]+?)\\s*\\|\\s*([^\\n|]+?)\\s*\\|\\s*([^\\n]+?)\\s*---\\n(.*?)---END LINT---")
    part = lambda k: F.regexp_extract_all(answer, pattern, k)
    each = F.arrays_zip(part(1).alias("kind"), part(2).alias("severity"), part(3).alias("title"), part(4).alias("body"))
    named = lambda b: F.filter(F.transform(F.split(F.regexp_extract(b, "(?m)^PAGES:\\s*([^\\n]*)$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(
        each,
        lambda x: F.struct(
            F.lower(x["kind"]).alias("kind"),
            F.lower(x["severity"]).alias("severity"),
            x["title"].alias("title"),
            named(x["body"]).alias("pages"),
            trimmed(F.regexp_replace(x["body"], "(?m)^PAGES:[^\\n]*\\n?", "")).alias("detail"),
        ),
    )


# What review items of findings say, and the choices that they give.
_NO_LINKS = "This page has no outbound [[wikilinks]]. Consider adding cross-references to related entities and concepts."
TITLE_CHARS = 80


def index_entries(findings: DataFrame, index: Column | None = None) -> DataFrame:
    """entry of each orphan among findings (kind, page, detail, affected_pages), once, that isn't in the index yet."""
    name = F.regexp_replace(F.replace("page", F.lit(".md"), F.lit("")), "^.*/", "")
    entries = findings.where("kind = 'orphan'").select(F.concat(F.lit("- [["), name, F.lit("]]")).alias("entry")).distinct()
    return entries if index is None else entries.where(~F.contains(index, F.col("entry")))


def with_entries(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index (content), or a new one, with entries below it, in their order."""
    lines = entries.agg(F.array_join(F.sort_array(F.collect_list("entry")), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))  # the index is one page
    own = index.select("content").unionByName(index.sparkSession.createDataFrame([("# Wiki Index\n",)], "content string")).limit(1)
    return own.crossJoin(F.broadcast(lines)).select(F.when(F.col("n") > 0, F.concat(F.regexp_replace("content", "\\s+$", ""), F.lit("\n"), F.col("lines"), F.lit("\n"))).otherwise(F.col("content")).alias("content"))


def review_items(findings: DataFrame, root: str = "") -> DataFrame:
    """Review items (type, title, description, pages, options) of the findings that aren't orphans."""
    page, kind = F.col("page"), F.col("kind")
    broken, alone = kind == "broken-link", kind == "no-outlinks"
    option = lambda label, action: F.struct(F.lit(label).alias("label"), action.alias("action"))
    edit, skip = option("Open & Edit", F.concat(F.lit("open:"), page)), option("Skip", F.lit("Skip"))
    return findings.where(kind != "orphan").select(
        F.when(alone, "suggestion").otherwise("confirm").alias("type"),
        F.when(broken, F.concat(F.lit("Fix broken link in "), page)).when(alone, F.concat(F.lit("Add cross-references to "), page)).otherwise(F.substring("detail", 1, TITLE_CHARS)).alias("title"),
        F.when(alone, _NO_LINKS).otherwise(F.col("detail")).alias("description"),
        F.when(broken | alone, F.array(page)).otherwise(F.coalesce("affected_pages", F.array(page))).alias("pages"),
        F.when(broken, F.array(edit, option("Delete Page", F.concat(F.lit(f"delete:{root}/wiki/"), page)), skip)).otherwise(F.array(edit, skip)).alias("options"),
    )


def fixes(findings: DataFrame) -> DataFrame:
    """findings (kind, page_id) with what repairs each: an index entry for orphans, a review for the rest."""
    return findings.withColumn("action", F.when(F.col("kind") == "orphan", "index-entry").otherwise("review-item"))
