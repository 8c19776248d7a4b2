"""Review items: parsing, merging of pending ones, and sweeping those that pages resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_review_title, slug, trimmed

TYPES = ("contradiction", "duplicate", "missing-page", "suggestion")
BATCH, BATCHES = 40, 5


def parsed(answer: Column) -> Column:
    """Structs of type, title, options, pages, queries and description, from a model's REVIEW blocks."""
    pattern = F.lit("(?s)---REVIEW:\\s*([^\\n|]+?)\\s*\\|\\s*([^\\n]+?)\\s*---\\n(.*?)---END REVIEW---")
    part = lambda k: F.regexp_extract_all(answer, pattern, k)
    each = F.arrays_zip(part(1).alias("kind"), part(2).alias("title"), part(3).alias("body"))

    def listed(body: Column, name: str, sep: str) -> Column:
        line = F.regexp_extract(body, f"(?m)^{name}:\\s*([^\\n]*)$", 1)
        return F.filter(F.transform(F.split(line, sep), lambda x: F.trim(x)), lambda x: x != "")

    return F.transform(
        each,
        lambda x: F.struct(
            F.when(F.lower(x["kind"]).isin(*TYPES), F.lower(x["kind"])).otherwise("confirm").alias("type"),
            x["title"].alias("title"),
            listed(x["body"], "OPTIONS", "\\|").alias("options"),
            listed(x["body"], "PAGES", ",").alias("pages"),
            listed(x["body"], "SEARCH", "\\|").alias("queries"),
            trimmed(F.regexp_replace(x["body"], "(?m)^(OPTIONS|PAGES|SEARCH):[^\\n]*\\n?", "")).alias("description"),
        ),
    )


def _ordered_union(lists: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", lists))), lambda x: x[lists])))


def merged(items: DataFrame) -> DataFrame:
    """Pending items of one type and normalised title as one: first id, all pages and queries in order, newest text.

    items: id, type, title, description, source_path, pages, queries, resolved, created_at.
    Resolved items stay apart.
    """
    pending = items.where(~F.col("resolved")).withColumn("key", normalize_review_title(F.col("title")))
    filled = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("created_at", "id", c)))[c]
    one = pending.groupBy("type", "key").agg(
        F.min(F.struct("created_at", "id", "title")).alias("f"),
        filled("description").alias("description"),
        filled("source_path").alias("source_path"),
        _ordered_union("pages").alias("pages"),
        _ordered_union("queries").alias("queries"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    return one.select("f.id", "type", "f.title", "key", "description", "source_path", "pages", "queries", F.col("f.created_at").alias("created_at"), "n_merged")


def names(title: Column, pages: Column) -> Column:
    """The names that an item's page may go by: its normalised title, and the stems of its pages."""
    plain = normalize_review_title(title)
    stems = F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda p: F.lower(F.regexp_replace(F.substring_index(p, "/", -1), "\\.md$", "")))
    return F.array_distinct(F.filter(F.concat(F.when(F.length(plain) <= 100, F.array(plain)).otherwise(F.array().cast("array<string>")), stems), lambda n: n != ""))


def swept(items: DataFrame, pages: DataFrame) -> DataFrame:
    """id and action of items that the pages (page_id, title) resolve.

    A missing page is resolved when a page has one of its names as id, as the id of its slug,
    or as title; a duplicate when one of its pages is gone. Others stay.
    """
    known = pages.select(F.lower("page_id").alias("n")).unionByName(pages.select(F.lower("title").alias("n")))
    missing = items.where("NOT resolved AND type = 'missing-page'").select("id", F.explode(names(F.col("title"), F.col("pages"))).alias("n"))
    by_slug = missing.select("id", slug(F.col("n")).alias("n")).join(pages.select(F.lower("page_id").alias("n")), "n", "left_semi")
    found = missing.join(known, "n", "left_semi").unionByName(by_slug.select("n", "id")).select("id").distinct().withColumn("action", F.lit("page-exists"))
    doubled = items.where("NOT resolved AND type = 'duplicate'").select("id", F.explode("pages").alias("page"))
    doubled = doubled.withColumn("page_id", F.lower(F.regexp_replace(F.substring_index("page", "/", -1), "\\.md$", "")))
    gone = doubled.join(pages.select(F.lower("page_id").alias("page_id")), "page_id", "left_anti").select("id").distinct().withColumn("action", F.lit("page-gone"))
    return found.unionByName(gone)


def batches(items: DataFrame) -> DataFrame:
    """Unresolved items with the batch in which a judge gets them; those beyond the last have none."""
    w = Window.orderBy("created_at", "id")
    first = items.where("NOT resolved").orderBy("created_at", "id").limit(BATCH * BATCHES)
    return first.withColumn("batch", F.floor((F.row_number().over(w) - 1) / BATCH).cast("int"))


# Words of actions that research, and actions that do nothing.
_RESEARCH = "research|investigate|explore|look into|研究|调研|探索"
_DISMISS = ("skip", "dismiss", "ignore", "跳过", "忽略", "approve", "keep existing", "no")


def action_kind(action: Column) -> Column:
    """research, dismiss or, for anything else, create."""
    low = F.lower(action)
    return F.when(~action.startswith("__") & low.rlike(_RESEARCH), "research").when(low.isin(*_DISMISS), "dismiss").otherwise("create")


def page_type(action: Column, review_type: Column) -> Column:
    """Of the page that an action creates."""
    low = F.lower(action)
    return (
        F.when(low.rlike("entity|实体"), "entity").when(low.rlike("concept|概念"), "concept").when(low.rlike("comparison|compare|比较"), "comparison")
        .when(low.rlike("synthesis|综合"), "synthesis").when(review_type == "missing-page", "concept").otherwise("query")
    )
