"""Chunks of markdown for embedding.

Sections are cut at headings; fenced code and tables stay whole; long paragraphs are split at
the coarsest separator that makes every piece short enough; pieces are packed, short chunks
joined to the next, and each but a section's first begins with the end of the one before.
A chunk's own text is always a slice of the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The default sizes.
TARGET, MOST, LEAST, OVERLAP = 1000, 1500, 200, 200
# Separators from coarse to fine; each stays with what is left of it.
SEPARATORS = (r"\n{2,}", r"\n+", r"[。！？!?；;]+\s*|\.\s+", r"\s+")

_FRONT = re.compile(r"---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_HEADING = re.compile(r"(#{1,6}) (.*)")
_FENCE = re.compile(r"(`{3,}|~{3,})")
_SENTENCE = re.compile(r"[。！？!?；;]\s*|\.\s")

SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("index", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("heading_path", T.StringType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
            T.StructField("oversized", T.BooleanType()),
        ]
    )
)


@dataclass
class Sizes:
    target: int = TARGET
    most: int = MOST
    least: int = LEAST
    overlap: int = OVERLAP

    def __post_init__(self):
        self.most = max(self.most, self.target)
        if self.overlap >= self.target:
            self.overlap = self.target // 2


def _lines(text: str, start: int, end: int):
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop + 1
        yield start, stop
        start = stop


def _closing(line: str, fence: str) -> bool:
    return line.rstrip("\r\n") == fence


def sections(text: str, begin: int) -> list[tuple[int, int, str]]:
    """(start, end, heading path); headings in fences don't count."""
    found, levels, start, path, fence = [], {}, begin, "", ""
    for a, b in _lines(text, begin, len(text)):
        line = text[a:b].rstrip("\r\n")
        if fence:
            fence = "" if _closing(line, fence) else fence
            continue
        if m := _FENCE.match(line):
            fence = m[1]
        elif m := _HEADING.match(line):
            if a > start:
                found.append((start, a, path))
            n = len(m[1])
            levels = {k: v for k, v in levels.items() if k < n} | {n: f"{m[1]} {m[2].strip()}"}
            start, path = a, " > ".join(levels[k] for k in sorted(levels))
    if start < len(text):
        found.append((start, len(text), path))
    return found


def atoms(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """(start, end, divisible) of fences, tables and paragraphs; blank lines go with what is before."""
    rows = list(_lines(text, start, end))
    found: list[tuple[int, int, bool]] = []
    i = 0

    def table(k: int) -> bool:
        return text[rows[k][0] : rows[k][1]].lstrip().startswith("|")

    while i < len(rows):
        first, line = i, text[rows[i][0] : rows[i][1]]
        if not line.strip():
            i += 1
            if found:
                found[-1] = (found[-1][0], rows[i - 1][1], found[-1][2])
            else:
                start_of = rows[first][0]
                while i < len(rows) and not text[rows[i][0] : rows[i][1]].strip():
                    i += 1
                if i == len(rows):
                    return [(start_of, end, True)]
                rows[i] = (start_of, rows[i][1]) if not (_FENCE.match(text[rows[i][0] : rows[i][1]]) or table(i)) else rows[i]
            continue
        if m := _FENCE.match(line):
            i += 1
            while i < len(rows) and not _closing(text[rows[i][0] : rows[i][1]], m[1]):
                i += 1
            i = min(i + 1, len(rows))
            found.append((rows[first][0], rows[i - 1][1], False))
            continue
        if table(i) and i + 1 < len(rows) and table(i + 1):
            while i < len(rows) and table(i):
                i += 1
            found.append((rows[first][0], rows[i - 1][1], False))
            continue
        i += 1  # a lone table line is a paragraph's beginning
        while i < len(rows):
            line = text[rows[i][0] : rows[i][1]]
            if not line.strip() or _FENCE.match(line) or table(i) and i + 1 < len(rows) and table(i + 1):
                break
            i += 1
        found.append((rows[first][0], rows[i - 1][1], True))
    return found


def split_paragraph(text: str, start: int, end: int, target: int) -> list[tuple[int, int]]:
    """Pieces of at most target, by the coarsest separator that makes all short enough, else by length."""
    for sep in SEPARATORS:
        cut, at = [], start
        for m in re.compile(sep).finditer(text, start, end):
            cut.append((at, m.end()))
            at = m.end()
        if at < end:
            cut.append((at, end))
        if len(cut) > 1 and all(b - a <= target for a, b in cut):
            return cut
    return [(a, min(a + target, end)) for a in range(start, end, target)]


def _snapped(tail: str) -> str:
    """The tail from after its first sentence end, else its first white space."""
    for pattern in (_SENTENCE, re.compile(r"\s+")):
        m = pattern.search(tail)
        if m and m.end() < len(tail):
            return tail[m.end() :]
    return tail


def chunk_markdown(content: str, sizes: Sizes | None = None) -> list[dict]:
    s = sizes or Sizes()
    content = content or ""
    m = _FRONT.match(content)
    begin = m.end() if m else 0
    out: list[dict] = []
    if not content[begin:].strip():
        return out
    for start, end, path in sections(content, begin):
        if not content[start:end].strip():
            continue
        if end - start <= s.target:
            spans = [(start, end)]
        else:
            small: list[tuple[int, int]] = []
            for a, b, divisible in atoms(content, start, end):
                small += split_paragraph(content, a, b, s.target) if divisible and b - a > s.target else [(a, b)]
            spans = []
            for a, b in small:
                if spans and b - spans[-1][0] <= s.target:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
            joined: list[tuple[int, int]] = []
            for a, b in spans:
                if joined and joined[-1][1] - joined[-1][0] < s.least and b - joined[-1][0] <= s.most:
                    joined[-1] = (joined[-1][0], b)
                else:
                    joined.append((a, b))
            spans = joined
        before = ""
        for a, b in spans:
            own = content[a:b]
            text = _snapped(before[-s.overlap :]) + own if before and s.overlap else own
            out.append({"index": len(out), "text": text, "heading_path": path, "char_start": a, "char_end": b, "oversized": len(text) > s.most})
            before = own
    return out


@pandas_udf(SCHEMA)
def chunk_udf(content: pd.Series) -> pd.Series:
    return content.map(chunk_markdown)


def chunks(pages: DataFrame) -> DataFrame:
    """page_id and a row for each chunk."""
    return pages.select("page_id", F.explode(chunk_udf("content")).alias("c")).select("page_id", F.concat_ws("#", "page_id", F.col("c.index").cast("string")).alias("chunk_id"), "c.*")


def fixed_windows(text: Column, size: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Structs of chunk_index, char_start and text for text without markdown, all native."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(float(step))).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk_index"), (k * step).alias("char_start"), F.substr(text, k * step + 1, F.lit(size)).alias("text")))


def enriched(title: Column, heading: Column, text: Column) -> Column:
    """What is embedded: title, heading and text, without blank ones."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n\n", part(title), part(heading), part(text))
