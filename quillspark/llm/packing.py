"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized where they are read, and only the pieces' lengths travel. Pieces
that fill a sequence stay alone. The others are dealt by a stored row number into shards of
bounded size; each shard is packed best-fit decreasing, and then improved by local search:
documents move, or are exchanged one for one or two for one, between underfull bins as long
as the sum of squared fills grows, which empties bins. Every document of every underfull bin, and every
two of a bin, are looked at; the search ends when none of these steps is left. A shard's size is a parameter, so no
task grows with the input; a shard wastes at most about a sequence more than one
large packing would.

Empty and null texts give one piece with the end token only. Repeated rows are packed once
for each row. No rows give no pieces. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stashed, tokenizer_path

SEQUENCE = 1024
END = 2
#: Pieces in a shard, on average.
SHARD = 16384
#: Words whose ids a Python worker remembers, and the longest of them.
CACHE, KEPT = 700_000, 64

_GAP = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s|\s\Z")


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's pattern never joins what stands on both sides of a single space, but
    for that space, which goes with the right side. So texts are cut there, and the ids of
    each part are looked up. New parts go to the rank file of the same vocabulary where it
    lies beside the given file, as that gives the same ids in half the time. Texts that hold
    an added token's string, such as the end token's, are given to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.encode = self.whole
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, end, out = self.known, struct.pack("<I", END), []
        for text in texts:
            if any(t in text for t in self.added):
                ids = self.whole(text)
                out.append(struct.pack(f"<{len(ids)}I", *ids) + end)
                continue
            head, *rest = text.split(" ") if not _DOUBLE.search(text) else _GAP.split(text)
            own = {}  # long parts, as of texts without spaces, aren't kept
            for part in [p for p in {*rest} if p not in known]:
                (known if len(part) <= KEPT else own)[part] = self.packed(" " + part)
            out.append(self.packed(head) + b"".join([known[p] if p in known else own[p] for p in rest]) + end)
        return out


#: One a Python worker; workers serve many tasks.
_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first have size ids."""
    first = n % size or size
    return [(0, min(n, first)), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and row, a number that no other piece has."""
    path = tokenizer_path(path)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = ids_of(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, got in zip(batch.column(0).to_pylist(), ids(texts)):
                for k, (start, length) in enumerate(cuts(len(got) // 4)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(got[4 * start : 4 * (start + length)]), row)):
                        column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")


class Bins:
    """Bins of one shard, packed best-fit decreasing and by local search."""

    def __init__(self, lengths: list[int], size: int = SEQUENCE):
        self.size, self.lengths = size, lengths
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        free: list[list[int]] = [[] for _ in range(self.size + 1)]
        mask = 0  # bit r: a bin has room for r
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
            else:
                room, b = self.size, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += n
            if room > n:
                free[room - n].append(b)
                mask |= 1 << (room - n)

    def improve(self) -> None:
        """Local search until no step is left; each raises the sum of squared fills."""
        for two_for_two in (False, True):  # the second kind has all steps of the first
            while self._pass(two_for_two):
                pass

    def _parts(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """Of each length that one item of the bin has, and that two have together, such items."""
        ones: dict[int, list[int]] = {}
        for i in self.items[b]:
            ones.setdefault(self.lengths[i], []).append(i)
        own = sorted(ones)
        twos = {m + n: (ones[m][0], ones[n][0]) for k, n in enumerate(own) for m in own[:k]}
        twos |= {2 * n: (i[0], i[1]) for n, i in ones.items() if len(i) > 1}
        return {n: (i[0],) for n, i in ones.items()}, twos

    def _pass(self, two_for_two: bool) -> bool:
        size, fill, items = self.size, self.fill, self.items
        under = [b for b in range(len(items)) if 0 < fill[b] < size]
        found: dict[int, tuple[dict, dict]] = {}  # parts of the bins that may give
        stamp = [0] * len(items)
        # Of each length, the bins that have it in one item and in two, by fill; bins of an old stamp have changed.
        heaps: tuple[list[list], list[list]] = ([[] for _ in range(size + 1)], [[] for _ in range(size + 1)])
        # The least of these fills, less the length: how full a bin must be, less what it gives, to get it.
        least = np.full((2, size + 1), np.inf)

        def put(b: int) -> None:
            found[b] = self._parts(b)
            for k, parts in enumerate(found[b]):
                for n in parts:
                    heappush(heaps[k][n], (fill[b], b, stamp[b]))
                    least[k, n] = min(least[k, n], fill[b] - n)

        def take(b: int) -> None:
            stamp[b] += 1
            for k, parts in enumerate(found.pop(b)):
                for n in parts:
                    heap = heaps[k][n]
                    while heap and heap[0][2] != stamp[heap[0][1]]:
                        heappop(heap)
                    least[k, n] = heap[0][0] - n if heap else np.inf

        for b in under:
            put(b)
        better = False
        for b in sorted(under, key=lambda b: (-fill[b], b)):
            if fill[b]:
                take(b)
            while 0 < fill[b] < size:
                room, best = size - fill[b], (0, None, 0, 0)
                ones, twos = self._parts(b)
                gives = [((), 0, (0, 1)), *((i, n, (0, 1)) for n, i in ones.items()), *((i, n, (0, 1) if two_for_two else (0,)) for n, i in twos.items())]
                for give, n, kinds in gives:
                    for k in kinds:
                        # what is longer than n by more than the best so far, in a bin less full than b would be
                        fits = np.flatnonzero(least[k, n + best[0] + 1 : n + room + 1] < fill[b] - n)
                        if len(fits):
                            gain = best[0] + 1 + int(fits[-1])
                            best = (gain, give, k, n + gain)
                gain, give, k, n = best
                if give is None:
                    break
                other = heaps[k][n][0][1]
                taken = found[other][k][n]
                take(other)
                items[b] = [i for i in items[b] if i not in give] + list(taken)
                items[other] = [i for i in items[other] if i not in taken] + list(give)
                fill[b] += gain
                fill[other] -= gain
                better = True
                if fill[other]:
                    put(other)
            if 0 < fill[b] < size:
                put(b)
        return better


def pack(lengths: list[int], size: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """The bin of each piece and its place there."""
    bins = Bins(lengths, size)
    bins.best_fit()
    bins.improve()
    at, offset, k = [0] * len(lengths), [0] * len(lengths), 0
    for own in bins.items:
        place = 0
        for i in own:
            at[i], offset[i] = k, place
            place += lengths[i]
        k += bool(own)
    return at, offset


def pack_documents(docs: DataFrame, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = stashed(pieces(docs, path))
    short = found.where(F.col("length") < SEQUENCE)
    shards = max(1, -(-short.count() // shard))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        at, offset = pack(rows["length"].tolist())
        rows["sequence_id"] = (int(rows["shard"].iloc[0]) << 32) + np.asarray(at, "int64")
        rows["offset"] = np.asarray(offset, "int64")
        return rows[columns]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    packed = short.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)
    whole = found.where(F.col("length") == SEQUENCE).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole)
