"""What fits into a model's context: budgets, packing of pages, the index, and citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the context, the floor of a page's share, seeds and their expansions.
DEFAULT_SIZE, RESERVE, INDEX, PAGES, PER_PAGE, PAGE_FLOOR = 204_800, 0.15, 0.05, 0.5, 0.3, 5_000
SEEDS, PER_SEED, LEAST_RELEVANCE = 10, 3, 2.0
CUT = "\n\n[...truncated...]"
TRIMMED = "\n\n[...index trimmed to relevant entries...]"


def budget(size: Column) -> Column:
    """A struct of max_ctx, response_reserve, index_budget, page_budget and max_page_size."""
    most = F.when(size > 0, size.cast("bigint")).otherwise(F.lit(DEFAULT_SIZE).cast("bigint"))
    part = lambda share, of: F.floor(of * F.lit(share)).cast("bigint")
    pages = part(PAGES, most)
    return F.struct(
        most.alias("max_ctx"),
        part(RESERVE, most).alias("response_reserve"),
        part(INDEX, most).alias("index_budget"),
        pages.alias("page_budget"),
        F.least(pages, F.greatest(F.lit(PAGE_FLOOR).cast("bigint"), part(PER_PAGE, pages))).alias("max_page_size"),
    )


def expansions(seeds: DataFrame, related: DataFrame) -> DataFrame:
    """Pages related to seeds: (id, relevance, place), each by the first seed that has it.

    seeds: id and rank. related: id, other, relevance and rank.
    """
    each = seeds.select(F.col("id"), F.col("rank").alias("seed_rank")).join(related.where(F.col("rank") <= PER_SEED), "id").where(F.col("relevance") >= LEAST_RELEVANCE)
    new = each.select(F.col("other").alias("id"), "relevance", "seed_rank", F.col("rank").alias("in_seed")).join(seeds.select("id"), "id", "left_anti")
    first = new.groupBy("id").agg(F.min(F.struct("seed_rank", "in_seed", "relevance")).alias("f"))
    w = Window.orderBy(F.desc("relevance"), "seed_rank", "in_seed")  # at most SEEDS * PER_SEED rows
    return first.select("id", "f.relevance", "f.seed_rank", "f.in_seed").withColumn("place", F.row_number().over(w)).select("id", "relevance", "place")


def packed(candidates: DataFrame, page_budget: int, max_page: int) -> DataFrame:
    """The candidates (query_id, page_id, priority, place, content) that fit, in order of priority and place.

    What doesn't fit is skipped, and later, smaller ones may still fit; so it is a fold over
    the few candidates of each query.
    """
    cut = F.when(F.length("content") > max_page, F.concat(F.substring("content", 1, max_page), F.lit(CUT))).otherwise(F.col("content"))
    rows = candidates.withColumn("content", cut).withColumn("n", F.length("content"))

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        used, kept = 0, []
        for n in own.sort_values(["priority", "place"], kind="stable").itertuples():
            if used < page_budget and used + n.n <= page_budget:
                used += n.n
                kept.append((n.query_id, n.page_id, n.priority, len(kept) + 1, n.n))
        return pd.DataFrame(kept, columns=["query_id", "page_id", "priority", "position", "n_chars"])

    sizes = rows.select("query_id", "page_id", "priority", "place", "n")
    fitting = sizes.groupBy("query_id").applyInPandas(fold, "query_id bigint, page_id string, priority int, position int, n_chars int")
    return fitting.join(rows.select("query_id", "page_id", "content"), ["query_id", "page_id"])


def trimmed_index(index: Column, tokens: Column, most: Column) -> Column:
    """Headings and lines with a token, as long as they fit."""
    lines = F.filter(F.split(index, "\n"), lambda x: x.startswith("##") | F.exists(tokens, lambda t: F.contains(F.lower(x), t)))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, line: Column) -> Column:
        after = s["used"] + F.length(line) + 1
        return F.when(after <= most, F.struct(after.cast("bigint").alias("used"), F.concat(s["kept"], F.array(line)).alias("kept"))).otherwise(s)

    kept = F.aggregate(lines, start, step, lambda s: F.array_join(s["kept"], "\n"))
    return F.when(F.length(index) <= most, index).when(F.length(kept) < F.length(index), F.concat(kept, F.lit(TRIMMED))).otherwise(kept)


def cited(answer: Column, n_pages: Column) -> Column:
    """Numbers of the pages that an answer cites: by its comment, else by brackets, in range."""
    listed = F.regexp_extract(answer, "<!--\\s*cited:\\s*([^>]*?)\\s*-->", 1)
    from_comment = F.transform(F.filter(F.split(listed, "[,\\s]+"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
    from_text = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[([0-9]+)\\]"), 1), lambda x: x.try_cast("int")))
    inside = lambda a: F.filter(a, lambda n: (n >= 1) & (n <= n_pages))
    return F.when(listed != "", inside(from_comment)).otherwise(inside(from_text))
