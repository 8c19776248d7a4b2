"""The edges where models come in: given callables, with defaults that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[str], list[float] | None]
LEAST_CHARS = 64


def hashing_embedder(dim: int = 64) -> Embedder:
    """Unit vectors of hashed words; equal texts have equal ones."""

    def embed(text: str) -> list[float]:
        v = np.zeros(dim)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return embed


def halving(embed: Embedder, retries: int = 3) -> Embedder:
    """Tries again with half the text where a text is too long, as long as over 64 characters are left; None if all fail."""

    def run(text: str) -> list[float] | None:
        for _ in range(retries + 1):
            try:
                return embed(text)
            except ValueError:
                if len(text) <= LEAST_CHARS:
                    return None
                text = text[: len(text) // 2]
                if len(text) < LEAST_CHARS:
                    return None
        return None

    return run


def embedded(chunks: DataFrame, embed: Embedder, column: str = "text") -> DataFrame:
    """chunks with vector; those for which none was made are left out."""
    run_one = halving(embed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.drop(columns=["vector"], errors="ignore").assign(vector=[run_one(t or "") for t in f[column]])
            yield f[f["vector"].notna()]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name != "vector")
    return chunks.mapInPandas(run, f"{schema}, vector array<float>")


def replayed(requests: DataFrame, recorded: DataFrame, key: str = "prompt") -> DataFrame:
    """requests with the answers of a recorded table (key, answer); '' where it has none."""
    return requests.join(recorded.select(key, "answer"), key, "left").na.fill("", ["answer"])


def judged(items: DataFrame, judge: Callable[[list[str]], list[str]], batch: int = 40) -> DataFrame:
    """Ids that a judge, asked in batches of ids, says are resolved; an error counts as none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                got = set(judge([str(i) for i in f["id"]]))
            except Exception:
                got = set()
            yield f[[str(i) in got for i in f["id"]]]

    numbered = items.select(F.col("id").cast("string").alias("id"), "batch")
    return numbered.groupBy("batch").applyInPandas(lambda f: next(run(iter([f]))), "id string, batch int").select("id")
