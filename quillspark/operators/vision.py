"""Work for vision models: captions of images, each image once, and the text of scanned pages.

Models are given callables. Every call is made once: what they answer is written to the session's folder before
anything reads it. at_once partitions bound how many calls run at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import trimmed
from quillspark.operators import media
from quillspark.sources.shared import stashed

Captioner = Callable[[bytes, str, str, str], str]
Reader = Callable[[bytes, int, int], str]
CACHE = "sha256 string, caption string, mime string, model string, captured_at timestamp"
# What begins the content of a scanned PDF, its payload, and what stands for one without any text.
MARKER = "__PDF_IMAGE_PAGES__"
PAYLOAD = "type string, page_count int, dpi int, pages array<string>"
NO_TEXT = "(OCR 未能提取到任何文字 — 请确认视觉模型已正确配置)"


def captions(pages: DataFrame, images: DataFrame, cache: DataFrame, caption: Captioner, model: str, at: Column, at_once: int = 4, prefix: str = "") -> dict[str, DataFrame]:
    """Captions for the images of pages (page_id, content), from a cache (CACHE) and, for what isn't there, from a model.

    images: page_id, url, mime and content of the image that a page's address means. An image goes out only if its
    address begins with prefix and its bytes' hash isn't in the cache, once, with the text round its first place. A call that fails leaves the image without a caption.

    pages: the pages with captions as alternative texts. cache: the old rows and those of new captions,
    each hash once, so that merging it again changes nothing. counts: by page the images with fresh and cached captions, and failed ones.
    """
    refs = media.references(pages).where(F.col("url").startswith(prefix))
    first = refs.groupBy("page_id", "url").agg(F.min(F.struct("pos", "before", "after")).alias("r")).select("page_id", "url", "r.pos", "r.before", "r.after")
    held = images.select("page_id", "url", "mime", F.sha2("content", 256).alias("sha256"))
    placed = stashed(first.join(held, ["page_id", "url"], "left"))
    missing = placed.where("sha256 IS NOT NULL").join(cache.select("sha256"), "sha256", "left_anti")
    asked = missing.groupBy("sha256").agg(F.min(F.struct("page_id", "pos", "url", "mime", "before", "after")).alias("a")).select("sha256", "a.*")
    asked = asked.join(images.select("page_id", "url", "content"), ["page_id", "url"]).dropDuplicates(["sha256"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told, errors = [], []
            for r in f.itertuples():
                try:
                    text, error = caption(bytes(r.content), r.mime, r.before, r.after), None
                except Exception as e:
                    text, error = None, f"{type(e).__name__}: {e}"
                told.append(text)
                errors.append(error)
            yield pd.DataFrame({"sha256": f["sha256"], "mime": f["mime"], "caption": told, "error": errors})

    answers = stashed(asked.repartition(at_once, "sha256").select("sha256", "mime", "before", "after", "content").mapInPandas(run, "sha256 string, mime string, caption string, error string"))
    new = answers.where("caption IS NOT NULL").select("sha256", "caption", "mime", F.lit(model).alias("model"), at.cast("timestamp").alias("captured_at"))
    old = cache.select("sha256", "caption", "mime", "model", "captured_at")
    known = old.select("sha256", "caption", F.lit("cached").alias("kind")).unionByName(new.select("sha256", "caption", F.lit("fresh").alias("kind")))
    named = placed.join(known, "sha256", "left")
    counts = named.groupBy("page_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("fresh", "cached")), F.count_if(F.col("kind").isNull()).alias("failed"))
    return {"pages": media.captioned(pages, named.where("kind IS NOT NULL").select("page_id", "url", "caption")), "cache": old.unionByName(new), "counts": counts}


def is_scanned(content: Column) -> Column:
    return content.startswith(MARKER)


def scanned_texts(files: DataFrame, read: Reader, at_once: int = 4) -> DataFrame:
    """path, text and error of scanned PDFs (path, content with MARKER), read page by page.

    Pages of all files are dealt out alike, so that a long file isn't one task's. A page that can't be read, or has no
    text, is left out; the others keep their order and numbers. A payload that isn't valid gives an error.
    """
    payload = files.where(is_scanned(F.col("content"))).select("path", F.from_json(F.substring("content", len(MARKER) + 1, 2**31 - 1), PAYLOAD).alias("p"))
    valid = F.coalesce((F.col("p.type") == "image_pages") & F.col("p.pages").isNotNull(), F.lit(False))
    each = payload.where(valid).select("path", F.size("p.pages").alias("total"), F.posexplode("p.pages").alias("page", "image"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for r in f.itertuples():
                try:
                    texts.append((read(base64.b64decode(r.image), r.page, r.total) or "").strip())
                except Exception:
                    texts.append("")
            yield pd.DataFrame({"path": f["path"], "page": f["page"], "text": texts})

    read_ = stashed(each.repartition(at_once, "path", "page").mapInPandas(run, "path string, page int, text string"))
    part = F.concat(F.lit("<!-- Page "), (F.col("page") + 1).cast("string"), F.lit(" -->\n"), trimmed(F.col("text")))
    whole = read_.where("text <> ''").groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"))
    done = payload.select("path", valid.alias("valid")).join(whole, "path", "left")
    return done.select("path", F.when(F.col("valid"), F.coalesce("text", F.lit(NO_TEXT))).alias("text"), F.when(~F.col("valid"), "Invalid image_pages payload").alias("error"))
