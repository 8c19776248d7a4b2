"""Images of pages: addresses, the raw file an image is from, captions, and the section that shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_path, trimmed

CONTEXT = 150
MARK = "<!-- embedded-images -->"


def is_absolute(url: Column) -> Column:
    return url.startswith("/") | url.rlike("^[a-zA-Z]:") | url.startswith("\\\\")


def absolute(url: Column, project: Column) -> Column:
    """A page's image address below the project's wiki folder; absolute ones stay."""
    return F.when(is_absolute(url), url).otherwise(F.concat(F.regexp_replace(project, "/+$", ""), F.lit("/wiki/"), F.regexp_replace(url, "^\\./", "")))


def resolved(url: Column, project: Column) -> Column:
    """Where an image is served from; web, data and file addresses stay, as do all without a project."""
    path = F.when(is_absolute(url), url).otherwise(F.concat(normalize_path(project), F.lit("/wiki/"), F.regexp_replace(url, "^\\./", "")))
    stays = (url == "") | url.rlike("(?i)^(https?:|data:|blob:|file:|tauri:)") | project.isNull()
    return F.when(stays, url).otherwise(F.concat(F.lit("/api/fs/media?path="), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))))


def raw_sources(images: DataFrame, files: DataFrame) -> DataFrame:
    """images (url) with source, the first raw file (path, name, ord) whose stem is the url's media folder."""
    stems = files.groupBy(F.regexp_replace("name", "\\.[^.]+$", "").alias("stem")).agg(F.min_by("path", "ord").alias("source"))
    folder = F.regexp_extract(normalize_path(F.col("url")), "(?:^|/)media/([^/]+)/", 1)
    return images.withColumn("stem", folder).join(stems, "stem", "left").drop("stem")


def references(pages: DataFrame) -> DataFrame:
    """page_id, pos, alt, url, and the text before and after each image.

    A page is cut once into its images and what is between them; what an image sees of both sides is
    carried along them, from the front and from the end.
    """
    pattern = "!\\[([^\\]]*)\\]\\(([^)\\s]+)\\)"
    cut = F.struct(F.split("content", pattern).alias("between"), *(F.regexp_extract_all("content", F.lit(pattern), k).alias(n) for k, n in ((0, "full"), (1, "alt"), (2, "url"))))
    found = pages.select("page_id", cut.alias("c")).where(F.size("c.full") > 0)
    nothing = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("seen"))
    at = lambda name, i: F.element_at(F.col(f"c.{name}"), i.cast("int"))

    def before(s: Column, i: Column) -> Column:
        text = F.right(F.concat(s["text"], at("between", i)), F.lit(CONTEXT))
        return F.struct(F.concat(text, at("full", i)).alias("text"), F.array_append(s["seen"], text).alias("seen"))

    def after(s: Column, i: Column) -> Column:
        text = F.left(F.concat(at("between", i + 1), s["text"]), F.lit(CONTEXT))
        return F.struct(F.concat(at("full", i), text).alias("text"), F.array_append(s["seen"], text).alias("seen"))

    n = F.size("c.full")
    front = F.aggregate(F.sequence(F.lit(1), n), nothing, before, lambda s: s["seen"])
    back = F.aggregate(F.sequence(n, F.lit(1)), nothing, after, lambda s: F.reverse(s["seen"]))
    both = F.arrays_zip(F.col("c.alt").alias("alt"), F.col("c.url").alias("url"), front.alias("before"), back.alias("after"))
    return found.select("page_id", F.posexplode(both).alias("pos", "i")).select("page_id", "pos", "i.alt", "i.url", "i.before", "i.after")


def alt_text(caption: Column) -> Column:
    """A caption that can't break the image's markdown."""
    return trimmed(F.replace(F.regexp_replace(caption, "[\\r\\n]+", " "), F.lit("]"), F.lit(")")))


def captioned(pages: DataFrame, captions: DataFrame) -> DataFrame:
    """pages (page_id, content) with the alt texts of images replaced by captions (page_id, url, caption)."""
    by_page = captions.groupBy("page_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("url", "caption")))).alias("captions"))
    parts = F.split("content", "(?=!\\[)|(?<=\\))")
    one = "^!\\[[^\\]]*\\]\\(([^)\\s]+)\\)$"

    def rewritten(p: Column) -> Column:
        url = F.regexp_extract(p, one, 1)
        caption = F.try_element_at(F.col("captions"), url)
        return F.when((url != "") & caption.isNotNull(), F.concat(F.lit("!["), alt_text(caption), F.lit("]("), url, F.lit(")"))).otherwise(p)

    new = F.when(F.col("captions").isNull(), F.col("content")).otherwise(F.array_join(F.transform(parts, rewritten), ""))
    return pages.join(by_page, "page_id", "left").select("page_id", new.alias("content"))


def section(images: DataFrame) -> DataFrame:
    """source and the markdown section of its images (source, index, page, rel_path, caption), by page, others last."""
    key = F.when(F.col("page").isNull(), "Document").otherwise(F.concat(F.lit("Page "), F.col("page").cast("string")))
    line = F.concat(F.lit("!["), F.coalesce(alt_text(F.col("caption")), F.lit("")), F.lit("]("), F.col("rel_path"), F.lit(")"))
    rows = images.select("source", F.coalesce("page", F.lit(2**31 - 1)).alias("place"), key.alias("key"), "index", line.alias("line"))
    pages = rows.groupBy("source", "place", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "key", "lines"))), lambda x: F.concat(F.lit("### "), x["key"], F.lit("\n\n"), x["lines"])), "\n\n")
    return pages.groupBy("source").agg(F.concat(F.lit("## Embedded Images\n\n"), text).alias("section"))


def with_section(content: Column, section: Column) -> Column:
    """The page with that section between marks, in place of an earlier one."""
    bare = F.regexp_replace(F.regexp_replace(content, f"\\n*{MARK}[\\s\\S]*?{MARK}\\n*", ""), "\\s+$", "")
    return F.when(section.isNull(), content).otherwise(F.concat(bare, F.lit(f"\n\n{MARK}\n"), section, F.lit(f"\n{MARK}\n")))


def without_images(content: Column) -> Column:
    """Each image as one space, for models that read text only."""
    return F.regexp_replace(content, "!\\[[^\\]]*\\]\\([^)\\s]+\\)", " ")
