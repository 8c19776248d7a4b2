"""Directories of files as DataFrames: listing order, categories, text of each kind of file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources import office

MOST_DEPTH = 30
# Extensions by category.
CATEGORIES = {
    "markdown": "md mdx",
    "text": "txt rtf log",
    "code": "js jsx ts tsx py rs go java c cpp h hpp rb php swift kt scala sh bash zsh sql r lua css scss less html htm xml svg vue svelte toml ini cfg conf dockerfile makefile",
    "image": "png jpg jpeg gif webp bmp ico tiff tif avif heic heif",
    "video": "mp4 webm mov avi mkv flv wmv m4v",
    "audio": "mp3 wav ogg flac aac m4a wma",
    "pdf": "pdf",
    "document": "doc docx xls xlsx ppt pptx odt ods odp pages numbers key epub",
    "data": "json jsonl csv tsv yaml yml ndjson",
}
_IMAGES = "png jpg jpeg gif webp svg bmp ico tiff avif heic"
_MEDIA = f"{CATEGORIES['video']} {CATEGORIES['audio']}"
_LEGACY = "doc xls ppt pages numbers key epub"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def category(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for c, exts in CATEGORIES.items() for e in exts.split() for x in (e, c)))
    return F.coalesce(known[F.lower(F.substring_index(path, ".", -1))], F.lit("unknown"))


# Languages of extensions; others go by the extension itself.
LANGUAGES = (
    "js javascript jsx javascript ts typescript tsx typescript py python rs rust go go java java rb ruby php php swift swift "
    "sql sql html html htm html css css json json yaml yaml yml yaml xml xml sh bash bash bash toml toml"
)


def code_language(path: Column) -> Column:
    """The language in which a file's text is shown."""
    end = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(F.create_map(*map(F.lit, LANGUAGES.split()))[end], end)


def is_text(category: Column) -> Column:
    return category.isin("markdown", "text", "code", "data")


def is_binary(category: Column) -> Column:
    return category.isin("image", "video", "audio", "document", "unknown")


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root), name, ext, dir, depth, modified, size and content; hidden files and folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = "^.*?" + _quoted(root.split("://", 1)[-1].rstrip("/")) + "/"
    rows = files.withColumn("path", F.regexp_replace(F.col("path"), base, ""))
    rows = rows.where(~F.col("path").rlike("(^|/)\\."))
    parts = F.split("path", "/")
    return rows.select(
        "path",
        F.element_at(parts, -1).alias("name"),
        extension(F.col("path")).alias("ext"),
        F.regexp_replace("path", "/?[^/]+$", "").alias("dir"),
        (F.size(parts) - 1).alias("depth"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("size"),
        "content",
    ).where(F.col("depth") <= MOST_DEPTH)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def order_key(path: Column) -> Column:
    """Sorts as a tree is walked: folders before files at each level, then by name."""
    parts = F.split(path, "/")
    marked = F.transform(parts, lambda p, i: F.concat(F.when(i < F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p))
    return F.array_join(marked, "\u0001")


def listed(files: DataFrame) -> DataFrame:
    """files with ord, the place in listing order; folders are numbered apart and then put in a row.

    A window for each folder numbers its files; only the folders' sizes meet in one place.
    """
    own = files.withColumn("ord_key", order_key(F.col("path"))).withColumn("folder_key", F.regexp_replace("ord_key", "1[^\u0001]*$", "1"))
    inner = Window.partitionBy("folder_key").orderBy("ord_key")
    sizes = own.groupBy("folder_key").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("folder_key").rowsBetween(Window.unboundedPreceding, -1)  # a row for each folder
    starts = sizes.select("folder_key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return own.join(starts, "folder_key").withColumn("ord", F.col("start") + F.row_number().over(inner) - 1).drop("ord_key", "folder_key", "start")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """page_id, ord, path and content of the markdown files below root, in listing order."""
    found = scan(spark, root, "*.md").withColumn("text", F.decode("content", "UTF-8"))
    return listed(found.drop("content")).select(F.regexp_replace("name", "\\.md$", "").alias("page_id"), "ord", "path", F.col("text").alias("content"))


def texts(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """files with text and error, by kind: what can't be read has a mark or an error, never a failed task.

    pdf gives the text of PDF bytes; no reader for them comes with this package.
    """
    rest = files.drop("text", "error")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_read(p, n, e, s, c, pdf) for p, n, e, s, c in zip(f["path"], f["name"], f["ext"], f["size"], f["content"])]
            yield pd.DataFrame({"path": f["path"], "text": [t for t, _ in got], "error": [e for _, e in got]})

    return rest.select("path", "name", "ext", "size", "content").mapInPandas(run, "path string, text string, error string")


def _read(path: str, name: str, ext: str, size: int, content: bytes, pdf) -> tuple[str | None, str | None]:
    content = bytes(content)
    if ext == "pdf":
        if pdf is None:
            return None, "no reader for PDF files is given"
        try:
            return pdf(content), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"
    if ext in office.READERS:
        return office.markdown(content, ext)
    if ext in _IMAGES.split():
        return f"[Image: {name} ({size / 1024:.1f} KB)]", None
    if ext in _MEDIA.split():
        return f"[Media: {name} ({size / 1048576:.1f} MB)]", None
    if ext in _LEGACY.split():
        return f"[Document: {name} — text extraction not supported for .{ext} format]", None
    try:
        return content.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, f"Failed to read file '{path}' as text: not UTF-8"


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, modified) whose cached text (path, cached_at) is missing or older."""
    return files.join(cache.select("path", "cached_at"), "path", "left").where(F.col("cached_at").isNull() | (F.col("cached_at") < F.col("modified"))).drop("cached_at")


def images(files: DataFrame) -> DataFrame:
    """path and a row for each embedded image of office files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"path": p, **i} for p, c in zip(f["path"], f["content"]) for i in office.images(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "index", "mime", "width", "height", "sha256", "page"]).astype({"page": "Int32"})

    return files.where(F.col("ext").isin(*office.READERS)).select("path", "content").mapInPandas(run, "path string, index int, mime string, width int, height int, sha256 string, page int")


def clips(raw: DataFrame) -> DataFrame:
    """path and content of web clips (title, url, content, clipped as a date); equal names are numbered from 2.

    Clips without content are left out; a missing title is Untitled.
    """
    rows = raw.where(F.coalesce("content", F.lit("")) != "").withColumn("title", F.coalesce("title", F.lit("Untitled"))).withColumn("url", F.coalesce("url", F.lit("")))
    words = F.trim(F.regexp_replace("title", "[^\\p{L}\\p{N} -]", " "))
    slug = F.substring(F.lower(F.regexp_replace(words, "\\s+", "-")), 1, 50)
    rows = rows.withColumn("base", F.concat(slug, F.lit("-"), F.date_format("clipped", "yyyyMMdd")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("url", F.xxhash64("content")))
    quoted = lambda c: F.replace(F.col(c), F.lit('"'), F.lit('\\"'))
    text = F.format_string(
        '---\ntype: clip\ntitle: "%s"\nurl: "%s"\nclipped: %s\norigin: web-clip\nsources: []\ntags: [web-clip]\n---\n\n# %s\n\nSource: %s\n\n%s\n',
        quoted("title"), quoted("url"), F.date_format("clipped", "yyyy-MM-dd"), F.col("title"), F.col("url"), F.col("content"),
    )
    path = F.concat(F.lit("raw/sources/"), F.col("base"), F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit(".md"))
    return rows.select(path.alias("path"), text.alias("content"))
