"""Runs of words that documents share with a set of items, such as a benchmark's.

The items' runs are a set of hashes that goes to the tasks, BLOCK of them at a time, so that its size is bounded whatever
the number of items; each block reads the documents once. A document is cut into words once, words that no item has break
its runs, and only runs whose hash is in the set leave the task, as text; those meet the items' runs by that text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.shared import stashed

RUN, BLOCK = 8, 1 << 19
_GAPS = re.compile("[ \t\n\x0b\f\r]+")
_FACTOR = 0x9E3779B97F4A7C15


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """One number for each run of n; ids are of words."""
    out = np.zeros(len(ids) - n + 1, "uint64")
    for k in range(n):
        out = (out + ids[k : len(ids) - n + 1 + k]) * np.uint64(_FACTOR)
        out ^= out >> np.uint64(29)
    return out


def _words(text: str | None) -> list[str]:
    return _GAPS.split((text or "").lower())


def shared_runs(docs: DataFrame, items: DataFrame, n: int = RUN) -> DataFrame:
    """doc_id, item_id and n_shared, the number of different runs of n words that both have; from docs (doc_id, text) and items (item_id, text).

    Words are what stands between white space, in lower case. Null texts share nothing.
    """
    spark = docs.sparkSession
    schema = "key bigint, run string"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.as_py(), g) for k, t in zip(batch.column(0), batch.column(1)) for w in [_words(t.as_py())] for g in {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["key", "run"])

    asked = stashed(items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(runs, schema).distinct())
    blocks = -(-asked.count() // BLOCK)
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("run"), F.lit(blocks)) == block)
        wanted = [r["run"].split(" ") for r in own.select("run").distinct().collect()]  # about BLOCK of them
        ids = {w: k + 1 for k, w in enumerate(sorted({w for g in wanted for w in g}))}
        known = np.unique(np.asarray([_hashes(np.asarray([ids[w] for w in g], "uint64"), n)[0] for g in wanted], "uint64"))

        def met(batches: Iterator[pa.RecordBatch], ids=ids, known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, found = [], []
                for key, text in zip(batch.column(0), batch.column(1)):
                    words = _words(text.as_py())
                    if len(words) < n:
                        continue
                    h = _hashes(np.asarray([ids.get(w, 0) for w in words], "uint64"), n)
                    at = np.searchsorted(known, h)
                    at[at == len(known)] = 0
                    for g in {" ".join(words[i : i + n]) for i in np.flatnonzero(known[at] == h).tolist()}:
                        keys.append(key.as_py())
                        found.append(g)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], names=["key", "run"])

        mine = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(met, schema).distinct()
        rows = mine.join(own.withColumnRenamed("key", "item_id"), "run").select(F.col("key").alias("doc_id"), "item_id")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_shared bigint")
    return out.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
