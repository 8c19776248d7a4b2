"""Wikilinks: extraction, resolution to pages by priority, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_key, slug, trimmed

WIKILINK = "\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]"


def targets(content: Column) -> Column:
    """All link targets, trimmed; repeated ones stay."""
    return F.transform(F.regexp_extract_all(content, F.lit(WIKILINK), 1), lambda t: trimmed(t))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos and raw target of each link."""
    return pages.select(F.col("page_id").alias("src"), F.col("ord").alias("src_ord"), F.posexplode(targets(F.col("content"))).alias("pos", "raw"))


def resolved(found: DataFrame, pages: DataFrame) -> DataFrame:
    """found with dst: the page of that very id, else the first in listing order whose id fits in lower case or as a slug.

    Both sides are spread over their keys, so that all is one equi-join and a minimum.
    """
    ids = pages.select(F.col("page_id").alias("dst"), "ord")
    low = F.lower(F.col("dst"))
    keys = ids.select("dst", "ord", F.explode(F.array_distinct(F.array(F.concat(F.lit("="), F.col("dst")), F.concat(F.lit("~"), low), F.concat(F.lit("~"), slug(F.col("dst")))))).alias("key"))
    raws = found.select("raw").distinct()
    tried = raws.select("raw", F.explode(F.array_distinct(F.array(F.concat(F.lit("="), F.col("raw")), F.concat(F.lit("~"), F.lower("raw")), F.concat(F.lit("~"), slug(F.col("raw")))))).alias("key"))
    best = tried.join(keys, "key").groupBy("raw").agg(F.min(F.struct((~F.col("key").startswith("=")).alias("inexact"), "ord", "dst")).alias("b")).select("raw", "b.dst")
    return found.join(best, "raw", "left")


def lint_keys(pages: DataFrame) -> DataFrame:
    """key and page_id: by relative path without extension and by base name, lower-cased; later pages win."""
    path = F.regexp_replace(F.regexp_replace("path", "^wiki/", ""), "\\.md$", "")
    each = pages.select("page_id", "ord", F.explode(F.array_distinct(F.array(F.lower(path), F.lower(F.substring_index(path, "/", -1))))).alias("key"))
    return each.groupBy("key").agg(F.max_by("page_id", "ord").alias("dst"))


def without_dead(content: Column, dead_keys: Column) -> Column:
    """Links whose key is among dead_keys become plain text; list rows that begin with one vanish."""
    lines = F.split(content, "\n")

    def dead(target: Column) -> Column:
        return F.array_contains(dead_keys, normalize_key(trimmed(target)))

    def first(line: Column) -> Column:
        return F.regexp_extract(line, "^\\s*[-*]\\s+\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]", 1)

    kept = F.filter(lines, lambda line: ~((first(line) != "") & dead(first(line))))

    def rewritten(line: Column) -> Column:
        parts = F.split(line, "(?=\\[\\[)|(?<=\\]\\])")
        name = lambda p: F.regexp_extract(p, "^\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]$", 1)
        shown = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^\\[\\[[^\\]|]+\\|([^\\]]*)\\]\\]$", 1), F.lit("")), name(p))
        return F.array_join(F.transform(parts, lambda p: F.when((name(p) != "") & dead(name(p)), shown(p)).otherwise(p)), "")

    return F.array_join(F.transform(kept, rewritten), "\n")


def with_math(answer: Column) -> Column:
    """Bare environments between dollar signs, as those who show formulas ask for; those that have them stay."""
    return F.regexp_replace(answer, "(?<!\\$\\$\\s{0,99})(\\\\begin\\{[^}]+\\}[\\s\\S]*?\\\\end\\{[^}]+\\})(?!\\s*\\$\\$)", "\\$\\$\n$1\n\\$\\$")


def rendered(answer: Column) -> Column:
    """Links as markdown: half-closed ones repaired, [[a|b]] and [[a]] as wikilink: targets; environments as formulas."""
    whole = F.regexp_replace(with_math(answer), "\\[\\[([^\\[\\]]+)\\](?!\\])", "[[$1]]")
    named = F.regexp_replace(whole, "\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]", "[$2](wikilink:$1)")
    return F.regexp_replace(named, "\\[\\[([^\\]|]+)\\]\\]", "[$1](wikilink:$1)")
