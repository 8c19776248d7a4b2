"""Keeping pages current: cache of hashes, merging of sources, duplicates of entities, blocks of generated files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillspark.functions import frontmatter as fm
from quillspark.functions.text import normalize_name
from quillspark.sources.shared import stashed

# Fixed values: (longest name, distance) at which names count as one.
NEAR = ((8, 1), (12, 2))


def cache_status(current: DataFrame, cached: DataFrame, files: DataFrame) -> DataFrame:
    """current (source, hash) with status hit, changed or new; a hit needs every file that it wrote.

    cached: source, hash, files_written. files: path of those that exist.
    """
    written = cached.select("source", F.explode("files_written").alias("path"))
    lost = written.join(files.select("path"), "path", "left_anti").select("source").distinct().withColumn("lost", F.lit(True))
    both = current.join(cached.select("source", F.col("hash").alias("old")), "source", "left").join(lost, "source", "left")
    status = F.when(F.col("old").isNull(), "new").when((F.col("old") == F.col("hash")) & F.col("lost").isNull(), "hit").otherwise("changed")
    return both.select("source", "hash", status.alias("status"))


def merged_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (path, content) after a write: the log grows, index and overview are replaced, others keep the sources of both."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    both = old.select("path", F.col("content").alias("old")).join(new.select("path", F.col("content").alias("new")), "path", "full_outer")
    union = fm.merged(fm.sources(F.col("old")), fm.sources(F.col("new")))
    content = (
        F.when(F.col("new").isNull(), F.col("old"))
        .when(F.col("old").isNull() | name.isin("index.md", "overview.md"), F.col("new"))
        .when(name == "log.md", F.concat_ws("\n", F.regexp_replace("old", "\\s+$", ""), "new"))
        .otherwise(fm.with_sources(F.col("new"), union))
    )
    return both.select("path", content.alias("content"))


def with_alias(content: Column, alias: Column) -> Column:
    """The page with an alias in its front matter, once, whatever its case."""
    old = fm.block(content)
    known = F.exists(fm.items(content, "aliases"), lambda a: F.lower(a) == F.lower(alias))
    both = F.concat(fm.items(content, "aliases"), F.array(alias))
    line = F.concat(F.lit("aliases: ["), F.array_join(F.transform(both, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))
    rest = F.regexp_replace(old, "(?m)^aliases:[^\\n]*(?:\\n[ \\t]+-[^\\n]*)*\\n?", "")
    tail = F.substr(content, F.length(old) + 5)
    return F.when((old == "") | known, content).otherwise(F.concat(F.lit("---\n"), F.regexp_replace(rest, "\\n$", ""), F.lit("\n"), line, tail))


def _deletions(name: Column, most: int) -> Column:
    """The name and all that is left of it without up to most characters."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    found = F.array(name)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, once))))
    return found


def contained(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """id, known_id and ord: of each na (id, na) the first nb (known_id, nb, ord) that holds it or that it holds, being longer or shorter.

    Names of least characters and more meet by their windows of the other's length. Each different
    name meets others once, and of what shares a key only the first goes on, so short names don't multiply.
    """
    windows = lambda name: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - F.col("n") + 1), lambda i: F.substr(name, i, F.col("n"))))
    lengths = lambda df, name: F.broadcast(df.select(F.length(name).alias("n")).distinct())  # noqa: E731  as many as names are long
    names = a.where(F.length("na") >= least).select("na").distinct()
    known = b.where(F.length("nb") >= least).groupBy("nb").agg(F.min(F.struct("ord", "known_id")).alias("f"))
    within = names.join(lengths(known, "nb"), F.length("na") > F.col("n")).select("na", F.explode(windows("na")).alias("nb")).join(known, "nb").select("na", "f")
    around = known.join(lengths(names, "na"), F.length("nb") > F.col("n")).select("f", F.explode(windows("nb")).alias("na")).groupBy("na").agg(F.min("f").alias("f")).join(names, "na").select("na", "f")
    best = within.unionByName(around).groupBy("na").agg(F.min("f").alias("f"))
    return a.join(best, "na").select("id", "f.known_id", "f.ord")


def name_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """For each new name (id, name) the first known (known_id, known_name, ord) that is similar.

    Names are similar when, normalised, they are equal, one holds the other, or few edits lie
    between. Candidates share a key: the name, a window of the other's length, or what is left
    after deleting as many characters as edits are allowed, in both; each is then verified. Each
    different name meets others once, and stands for the first known one of that name.
    """
    own = stashed(new.select("id", normalize_name(F.col("name")).alias("na")).where("na IS NOT NULL"))
    a = stashed(own.select(F.col("na").alias("id"), "na").distinct())
    b = stashed(known.groupBy(normalize_name(F.col("known_name")).alias("nb")).agg(F.min(F.struct("ord", "known_id")).alias("f")).select("f.known_id", "f.ord", "nb"))
    pairs = [a.join(b, a["na"] == b["nb"]).select("id", "known_id", "ord"), contained(a, b)]
    most = max(n for n, _ in NEAR)
    for longest, edits in NEAR:
        left = a.where(F.length("na") <= longest).select("id", "na", F.explode(_deletions(F.col("na"), edits)).alias("key")).repartition("key")  # stored names are few bytes, their keys many
        right = b.where(F.length("nb") <= longest).select("known_id", "nb", "ord", F.explode(_deletions(F.col("nb"), edits)).alias("key")).repartition("key")
        near = left.join(right, "key").where(F.levenshtein("na", "nb") <= edits)
        pairs.append(near.select("id", "known_id", "ord"))
    assert most <= 12
    first = lambda df: df.groupBy("id").agg(F.min(F.struct("ord", "known_id")).alias("f")).select("id", "f.ord", "f.known_id")
    best = first(reduce(DataFrame.unionByName, pairs)).withColumnRenamed("id", "na")
    return first(own.join(best, "na")).select("id", "known_id")


_OPEN = re.compile(r"^\s*---\s*FILE\s*:\s*(.*?)\s*---\s*$", re.I)
_CLOSE = re.compile(r"^\s*---\s*END\s+FILE\s*---\s*$", re.I)
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_SAFE = re.compile(r"^wiki/(?!.*(?:^|/)\.\.(?:/|$))[^\0]+$")


def file_blocks(answer: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(path, content) of the FILE blocks of a model's answer, and warnings.

    Closing marks inside code fences are content. Unclosed, empty and unsafe blocks only warn.
    """
    found, warnings = [], []
    lines = answer.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        m = _OPEN.match(lines[i])
        i += 1
        if not m:
            continue
        path, own, fence, closed = m[1], [], "", False
        while i < len(lines):
            line = lines[i]
            i += 1
            f = _FENCE.match(line)
            if fence:
                if f and f[1][0] == fence[0] and len(f[1]) >= len(fence):
                    fence = ""
            elif f:
                fence = f[1]
            elif _CLOSE.match(line):
                closed = True
                break
            own.append(line)
        if not path:
            warnings.append("block without path")
        elif not closed:
            warnings.append(f"unclosed block: {path}")
        elif not _SAFE.match(path.replace("\\", "/")):
            warnings.append(f"unsafe path: {path}")
        else:
            found.append((path, "\n".join(own)))
    return found, warnings


_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])


@pandas_udf(T.StructType([T.StructField("files", T.ArrayType(_FILE)), T.StructField("warnings", T.ArrayType(T.StringType()))]))
def parse_files(answers: pd.Series) -> pd.DataFrame:
    rows = [file_blocks(a or "") for a in answers]
    return pd.DataFrame({"files": [[{"path": p, "content": c} for p, c in f] for f, _ in rows], "warnings": [w for _, w in rows]})


def json_object(answer: str) -> str:
    """The first balanced object of an answer, without fences; '' if there is none."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", answer.strip())
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return ""


@pandas_udf(T.StringType())
def extract_json(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: json_object(a or ""))


def linked(content: str, terms: list[tuple[str, str]]) -> str:
    """The first unlinked place of each (term, target), outside front matter, becomes a link."""
    m = re.match(r"---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", content, re.S)
    head, body = (content[: m.end()], content[m.end() :]) if m else ("", content)
    done: set[str] = set()
    for term, target in terms:
        if not term or target in done:
            continue
        spans = [x.span() for x in re.finditer(r"\[\[.*?\]\]", body)]
        at = body.find(term)
        while at >= 0 and any(a <= at < b for a, b in spans):
            at = body.find(term, at + 1)
        if at < 0:
            continue
        done.add(target)
        body = f"{body[:at]}[[{term}]]{body[at + len(term):]}" if term == target else f"{body[:at]}[[{target}|{term}]]{body[at + len(term):]}"
    return head + body


def apply_links(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """pages (page_id, content) with the links of terms (page_id, term, target, pos)."""
    own = terms.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term", "target"))), lambda x: F.struct(x["term"], x["target"])).alias("terms"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["content"] = [c if t is None else linked(c, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in t]) for c, t in zip(f["content"], f["terms"])]
            yield f[["page_id", "content"]]

    return pages.join(own, "page_id", "left").select("page_id", "content", "terms").mapInPandas(run, "page_id string, content string")
