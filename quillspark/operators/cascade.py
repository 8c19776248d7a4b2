"""What follows from deleting a source: related pages, their fate, and links to what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import frontmatter as fm
from quillspark.functions.text import normalize_key
from quillspark.operators.links import targets, without_dead
from quillspark.sources.shared import stashed

STRUCTURAL = ("index.md", "log.md", "overview.md")


def related_pages(pages: DataFrame, source: str) -> DataFrame:
    """Pages that quote the file, summarise it below sources/, or name it in their sources."""
    low, name = F.lower("content"), source.lower()
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    file = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    quoted = F.contains(low, F.lit(f'"{name}"'))
    summary = F.col("path").rlike("(^|/)sources/") & file.startswith(stem)
    listed = F.contains(F.regexp_extract(fm.block(low), "(?m)^(sources:[^\\n]*(?:\\n[ \\t][^\\n]*|\\n(?=\\n))*)", 1), F.lit(name))
    return pages.where(~file.isin(*STRUCTURAL) & (quoted | summary | listed))


def fate(sources: Column, deleted: Column) -> Column:
    """A struct of action (skip, keep or delete) and the sources that stay."""
    left = F.filter(sources, lambda s: F.lower(s) != F.lower(deleted))
    action = F.when(F.size(left) == F.size(sources), "skip").when(F.size(left) > 0, "keep").otherwise("delete")
    return F.struct(action.alias("action"), left.alias("survivors"))


def delete_source(pages: DataFrame, source: str) -> DataFrame:
    """page_id, action and new content of pages that deleting the source changes; null content for those to delete.

    Links to deleted pages, by id or title, become text in all other pages.
    """
    judged = related_pages(pages, source).withColumn("f", fate(fm.sources(F.col("content")), F.lit(source)))
    changed = judged.where("f.action <> 'skip'").select("page_id", "path", "content", F.col("f.action").alias("action"), F.col("f.survivors").alias("survivors"))
    gone = changed.where("action = 'delete'").select("page_id", fm.title(F.col("content"), F.col("path")).alias("title"))
    keys = gone.select(F.explode(F.array(normalize_key(F.col("page_id")), normalize_key(F.col("title")))).alias("key")).distinct()
    linked = pages.select("page_id", F.explode(F.array_distinct(F.transform(targets(F.col("content")), normalize_key))).alias("key"))
    dead = linked.join(keys, "key", "left_semi").groupBy("page_id").agg(F.collect_set("key").alias("dead"))  # at most a page's own links
    every = pages.join(changed.select("page_id", "action", "survivors"), "page_id", "left").join(dead, "page_id", "left")
    kept = F.when(F.col("action") == "keep", fm.with_sources(F.col("content"), F.col("survivors"))).otherwise(F.col("content"))
    new = F.when(F.coalesce("action", F.lit("")) != "delete", F.when(F.col("dead").isNotNull(), without_dead(kept, F.col("dead"))).otherwise(kept))
    out = every.select("page_id", F.coalesce("action", F.when(new != F.col("content"), "relink")).alias("action"), new.alias("content"))
    return out.where("action IS NOT NULL")


def delete_everywhere(pages: DataFrame, chunks: DataFrame, media: DataFrame, cache: DataFrame, source: str, date: str) -> dict[str, DataFrame]:
    """What is left of pages, chunks (page_id), media (path) and cache (source) when a source goes, and the log's new entry.

    Chunks go with the pages that are deleted, images with the source's own folder of media, and
    the source's row of the cache. log has one row, entry, as it is to be appended.
    """
    changed = stashed(delete_source(pages, source))  # five results read it
    gone = changed.where("action = 'delete'").select("page_id")
    kept = pages.join(gone, "page_id", "left_anti").join(changed.where("action <> 'delete'").select("page_id", F.col("content").alias("new")), "page_id", "left")
    left = kept.withColumn("content", F.coalesce("new", "content")).select(pages.columns)
    folder = "wiki/media/" + (source.rsplit(".", 1)[0] if "." in source[1:] else source) + "/"
    related = stashed(related_pages(pages, source).agg(F.count(F.lit(1)).alias("n")))
    n, k = gone.agg(F.count(F.lit(1)).alias("gone")), F.col("n") - F.col("gone")
    shared = F.when(k > 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" shared pages kept (have other sources)."))).otherwise("")
    entry = F.concat(F.lit(f"\n## [{date}] delete | {source}\n\nDeleted source file and "), F.col("gone").cast("string"), F.lit(" wiki pages."), shared, F.lit("\n"))
    return {
        "pages": left,
        "chunks": chunks.join(gone, "page_id", "left_anti"),
        "media": media.where(~F.col("path").startswith(folder)),
        "cache": cache.where(F.col("source") != source),
        "log": n.crossJoin(related).select(entry.alias("entry")),
    }
