"""Ranked lexical search, score-at-a-time over postings in order of their impacts.

Terms are cut from the whole text's bytes: runs of letters and digits of ASCII and of all other
characters, only A-Z lower-cased. A first pass over the documents writes, of each, its number of
terms and how often it holds each term that the items ask for; counts over all documents
come from that table. A second pass builds small indexes of it, SHARD postings at a time: a term's
postings stand in the order of their exact impact, weight * ((10^9 * tf) div (1000 * tf + 20 * m)).

An item is scored over an index from its highest impacts down, a step of levels at a time; all
postings of equal impact fall in the same step. After each step the terms' next impacts
bound what a document can still gain, less those of terms that it has been met with. The item is done when no more documents may be in its
result than are asked for, and no other can reach them; their scores are then completed from
the documents' own terms. Each task hands on TOP rows an item, which are merged in two rounds.

Items are dealt to blocks of about BLOCK bytes of text; each block's terms, which that
bounds, go to the tasks, and each block reads the documents once.

Null texts have no terms; they count in nothing. Repeated documents each count and are each
ranked; of equal scores the smaller doc_id is first, null ids last, rows of one id in any order. Items with
one id and text are one item; of one id with different texts each has a list of its own under that id. Items
without terms, or whose terms no document has, have no rows. Long texts are read whole.
No documents or no items give no rows. Columns other than those named aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.llm.common import stashed

TOP = 50
#: Postings of an index that a task holds at a time.
SHARD = 1 << 21
#: Bytes of items' texts whose terms are sent to tasks at a time.
BLOCK = 4 << 20
#: Steps in which an item's postings are read, at most.
STEPS = 12
#: Documents whose own bounds are looked at, if the common bound leaves no more.
CLOSE = 1 << 13
#: Groups in which tasks' rows of an item meet first.
GROUPS = 32

# What isn't part of a term is a space, capital letters are small ones; bytes of other characters stay.
_TO = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)).lower() + bytes(range(128, 256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms with repeats), terms (numbers of known ones that it holds, ascending) and tfs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own, tfs = [], [], []
            for text in batch.column(1):  # one text at a time
                found = terms(text.as_py())
                sizes.append(len(found))
                held = sorted((known[t], k) for t, k in Counter(found).items() if t in known)
                own.append([t for t, _ in held])
                tfs.append([k for _, k in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, schema.field(2).type), pa.array(tfs, schema.field(3).type)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of n terms; exact also where 64 bits wouldn't do."""
    if len(n) and int(n.max()) * 50 * n_docs >= 1 << 62:
        return np.asarray([50 + 50 * int(x) * n_docs // max(1, total) for x in n], "int64")
    return 50 + n * (50 * n_docs) // max(1, total)


class Index:
    """Postings of some documents, by term in descending order of their scores without the term's weight."""

    def __init__(self, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        """starts: of each document where its terms begin in terms and tfs, and the end."""
        self.n, self.starts, self.terms = len(m), starts, terms
        own = np.repeat(np.arange(self.n, dtype="int32"), np.diff(starts))
        self.scores = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[own])
        order = np.lexsort((-self.scores, terms))
        self.docs, self.impacts = own[order], self.scores[order]
        cut = np.flatnonzero(np.r_[True, np.diff(terms[order]) != 0]) if len(terms) else np.zeros(0, "int64")
        self.places = dict(zip(terms[order][cut].tolist(), zip(cut.tolist(), [*cut[1:].tolist(), len(terms)])))

    def top(self, weights: dict[int, int], most: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents that may be among the most best of an item with these weights by term, their scores, and how many postings were read.

        Ties at the end are all there. floor: a score that `most` documents elsewhere have.
        """
        lists = [(w, *self.places[t]) for t, w in weights.items() if w > 0 and t in self.places]
        got, met = np.zeros(self.n, "int64"), np.zeros(self.n, "uint64")
        left = sum(b - a for _, a, b in lists)
        heads, read = [a for _, a, _ in lists], 0
        tops = [w * int(self.impacts[a]) for w, a, _ in lists]
        high = max(tops, default=0)
        for step in range(STEPS + 1):
            # at the last step all that is left is read
            level = 0 if step == STEPS else high * (STEPS - 1 - step) // STEPS
            bound = 0
            for k, (w, a, b) in enumerate(lists):
                if heads[k] < b and tops[k] > level:
                    # impacts descend: those over the level come first
                    own = self.impacts[heads[k] : b]
                    n = int(np.searchsorted(-own, -(level // w), "left"))
                    docs = self.docs[heads[k] : heads[k] + n]
                    got[docs] += w * own[:n]
                    if k < 64:
                        met[docs] |= np.uint64(1 << k)
                    heads[k] += n
                    read += n
                    tops[k] = w * int(self.impacts[heads[k]]) if heads[k] < b else 0
                bound += tops[k]
            if read == 0:
                continue
            least = max(int(np.partition(got, -most)[-most]) if self.n > most else 0, floor, 1)
            may = np.flatnonzero(got + bound >= least)
            if bound and most < len(may) <= CLOSE:  # a document can't gain from a term that it has been met with
                gain = np.full(len(may), bound)
                for k, top in enumerate(tops[:64]):
                    gain -= top * (met[may] >> np.uint64(k) & np.uint64(1)).astype("int64")
                may = may[got[may] + gain >= least]
            if bound == 0 or len(may) <= most:
                break
        else:
            may = np.flatnonzero(got)
        scores = got[may] if read == left else self.complete(may, weights)
        some = scores >= max(floor, 1)
        return may[some], scores[some], read

    def complete(self, docs: np.ndarray, weights: dict[int, int]) -> np.ndarray:
        """The whole scores of these documents, from their own terms."""
        own = np.asarray(sorted(weights), self.terms.dtype)
        w = np.asarray([weights[t] for t in own.tolist()], "int64")
        out = np.zeros(len(docs), "int64")
        for k, d in enumerate(docs.tolist()):
            a, b = self.starts[d], self.starts[d + 1]
            at = np.searchsorted(own, self.terms[a:b])
            at[at == len(own)] = 0
            held = own[at] == self.terms[a:b]
            out[k] = (w[at[held]] * self.scores[a:b][held]).sum()
        return out


def _best(ids: list, scores: np.ndarray, most: int) -> list[tuple]:
    """The best (score, doc_id) of an item, in order."""
    return sorted(zip(scores.tolist(), ids), key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:most]


def found(counts: DataFrame, items: list[dict[int, int]], n_docs: int, total: int, most: int) -> DataFrame:
    """nth, doc_id and score: of each item (weights by term) the best of each task's documents."""
    schema = pa.schema([("nth", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> None:
            nonlocal size
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            size = 0
            own = table.column("terms").combine_chunks()
            starts = np.r_[0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))].astype("int64")
            index = Index(lengths(table.column("n").to_numpy(), n_docs, total), starts, own.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy())
            ids = table.column("doc_id")
            for k, weights in enumerate(items):
                floor = best[k][-1][0] if len(best[k]) == most else 0
                docs, scores, _ = index.top(weights, most, floor)
                if len(docs):
                    new = _best(ids.take(pa.array(docs)).to_pylist(), scores, most)
                    best[k] = _best([d for _, d in best[k] + new], np.asarray([s for s, _ in best[k] + new], "int64"), most)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).values)
            if size >= SHARD:
                done()
        if held:
            done()
        rows = [(k, d, s) for k, own in enumerate(best) for s, d in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), schema)], schema=schema)

    return counts.mapInArrow(run, "nth int, doc_id bigint, score bigint")


def searched(docs: DataFrame, items: DataFrame, most: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the most best documents (doc_id, text) for each of items (item_id, text)."""
    spark = docs.sparkSession
    asked = stashed(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct())
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK)
    out = None
    for block in range(blocks):
        # a block of items: about BLOCK bytes, or one longer item's
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        held = [sorted(set(terms(r["text"]))) for r in own]
        known = {t: k for k, t in enumerate(sorted(set().union(*held)))}
        counts = stashed(counted(docs, known))
        n_docs, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["df"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weights = [{known[t]: weight(n_docs, df[known[t]]) for t in h if known[t] in df} for h in held]
        rows = found(counts.where(F.size("terms") > 0), weights, n_docs, total, most)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["nth", "group"], ["nth"]):
            rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
        ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(own)], "nth int, item_id bigint")
        rows = rows.join(F.broadcast(ids), "nth").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
