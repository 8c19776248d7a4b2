"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from its start into phrases, each the shortest that no earlier one equals.
The phrases' hashes form a set, of which the PICKED least are the fingerprint; the share of
common ones among the least of two together estimates the sets' likeness, as shared phrases
do the gain of compressing both texts with one dictionary.

With each document goes an edited text: its last quarter gives way to the next document's
start. Documents are dealt into buckets by ranges of ids, so that the next one is in the same
bucket but for each bucket's last, which gets a copy of the next bucket's first. Many rows of one
id, or without one, are dealt by ranges of their texts' hashes. Tasks read their buckets in order
and hold two documents at a time.

Null and empty texts have the empty fingerprint; two empty ones have likeness 1, an empty one
and another 0. Of rows with equal ids the order is that of their texts' hashes; null ids come first.
A single document is its own next. No rows give no rows. Columns other than doc_id and text
aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes in a fingerprint.
PICKED = 64
#: Documents in a bucket, about, and buckets at most; of more documents a bucket holds more, but
#: tasks read them one after the other.
BUCKET_ROWS = 500
MOST_BUCKETS = 20_000
#: Documents of a task, at least, where there are more than shuffle partitions hold.
TASK_ROWS = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and its inverse, as far as asked for."""

    def __init__(self):
        self.n = 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = 1 << n.bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(self.n, _BASE, "uint64")], dtype="uint64")
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(self.n, _INVERSE, "uint64")], dtype="uint64")


_POWERS = _Powers()


def _parse(text: str, seen: dict[str, None], phrase: str) -> str:
    """Adds phrases of text to seen, in order; what is left over. phrase: what was before."""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen[phrase] = None
            phrase = ""
    return phrase


def _hashes(text: str, lengths: np.ndarray) -> np.ndarray:
    """Of the phrases of these lengths, which follow each other from the start of text."""
    stop = np.cumsum(lengths)
    text = text[: int(stop[-1])] if len(stop) else ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64") + np.uint64(1)
    _POWERS.grow(len(codes) + 1)
    total = np.zeros(len(codes) + 1, "uint64")
    np.cumsum(codes * _POWERS.up[: len(codes)], out=total[1:])
    start = stop - lengths
    h = (total[stop] - total[start]) * _POWERS.down[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype("uint32")


def _least(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) > 4 * PICKED:
        hashes = np.partition(hashes, 2 * PICKED)[: 2 * PICKED]
    return np.unique(hashes)[:PICKED]


def _lengths(seen: dict[str, None], start: int = 0) -> np.ndarray:
    return np.fromiter(map(len, islice(seen, start, None)), "int64", len(seen) - start)


def fingerprint(text: str) -> np.ndarray:
    seen: dict[str, None] = {}
    _parse(text, seen, "")
    return _least(_hashes(text, _lengths(seen)))


def fingerprints(text: str, edited: str) -> tuple[np.ndarray, np.ndarray]:
    """Of both; what they have in common at the start is parsed once."""
    cut = len(text) - len(text) // 4
    seen: dict[str, None] = {}
    phrase = _parse(text[:cut], seen, "")
    shared = len(seen)
    _parse(text[cut:], seen, phrase)
    own = _hashes(text, _lengths(seen))
    while len(seen) > shared:
        seen.popitem()
    _parse(edited[cut:], seen, phrase)
    late = _hashes(edited[cut - len(phrase) :], _lengths(seen, shared))
    return _least(own), _least(np.concatenate([own[:shared], late]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    both = sorted(x | y)[:PICKED]
    return sum(h in x and h in y for h in both) / len(both)


def told(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def bucketed(docs: DataFrame, rows: int, nulls: int) -> DataFrame:
    """docs with hash, of the text, and bucket, which grows with id and hash."""
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    of_null = -(-buckets * nulls // rows)
    docs = docs.withColumn("hash", F.xxhash64("text"))
    share = (F.col("hash").cast("double") / F.lit(float(1 << 64)) + F.lit(0.5)).cast("double")  # 0 to 1

    def part(n: Column) -> Column:
        return F.least(F.floor(share * n), n - 1).cast("int")

    probabilities = [k / (buckets - of_null) for k in range(1, buckets - of_null)]
    edges = [int(e) for e in docs.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", probabilities, 0.2 / buckets)] if probabilities else []
    bucket = F.lit(0)
    if edges:
        # different edges, each with the number of edges before it and of its kind: an id that is an edge often has so many buckets
        times = sorted(Counter(edges).items())
        before = list(accumulate((n for _, n in times), initial=0))
        cells = [F.struct(F.lit(e).cast("bigint").alias("id"), F.lit(b).alias("before"), F.lit(n).alias("n")) for (e, n), b in zip(times, before)]
        wide = max(1, int(len(cells) ** 0.5))  # searched in blocks, so that each row compares few
        heads = F.array(*(F.lit(e).cast("bigint") for e, _ in times[::wide]))
        table = F.array(*(F.array(*cells[k : k + wide]) for k in range(0, len(cells), wide)))
        block = F.size(F.filter(heads, lambda e: e <= F.col("doc_id")))
        inner = F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda c: c["id"] <= F.col("doc_id"))
        last = F.element_at(inner, F.greatest(F.size(inner), F.lit(1)))
        found = last["before"] + F.when(last["id"] == F.col("doc_id"), part(last["n"]) + 1).otherwise(last["n"])
        bucket = F.when(block == 0, F.lit(0)).otherwise(found)
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), part(F.lit(max(1, of_null)))).otherwise(F.lit(of_null) + bucket).cast("int"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    spark = docs.sparkSession
    rows, ids = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not rows:
        return spark.createDataFrame([], schema)
    dealt = bucketed(docs, rows, rows - ids)
    # null ids come first in a struct too
    firsts = sorted((r["bucket"], r["first"]["doc_id"], r["first"]["hash"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect())
    tails = spark.createDataFrame([(b, i, h, firsts[k - 1][0]) for k, (b, i, h) in enumerate(firsts)], "tail_bucket int, tail_id bigint, tail_hash bigint, to int")  # the first one's is the last
    of_tail = (F.col("bucket") == F.col("tail_bucket")) & F.col("doc_id").eqNullSafe(F.col("tail_id")) & (F.col("hash") == F.col("tail_hash"))
    # equal rows give several copies, of which the first counts
    copies = dealt.join(F.broadcast(tails), of_tail).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("tail"), "hash")
    every = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("tail"), "hash").unionByName(copies)
    tasks = min(len(firsts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS))
    ordered = every.repartition(tasks, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "hash", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    arrow = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # bucket, id and text of the document before
        before = None  # the row of the one before that, which lacks only near_next, and its fingerprint
        ready: list[list] = []

        def told_next(f: np.ndarray) -> None:
            if before is not None:
                ready.append([*before[0], likeness(before[1], f)])

        for batch in batches:
            for doc, text, bucket, tail in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if waiting is not None and waiting[0] == bucket:
                    own, edited = waiting[2], edited_text(waiting[2], text)
                    f, g = fingerprints(own, edited)
                    told_next(f)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    before = [waiting[1], len(own), sha, told(f), told(g), likeness(f, g)], f
                    if tail:
                        told_next(fingerprint(text))
                if tail:
                    waiting = before = None
                else:
                    waiting = bucket, doc, text
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], t) for k, t in enumerate(types)], schema=arrow)
                ready.clear()

    return ordered.mapInArrow(run, schema)
