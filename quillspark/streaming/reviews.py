"""Review items as a stream: pending ones of one type and title are one item, kept as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.text import normalize_review_title
from quillspark.operators import reviews
from quillspark.streaming import queue

ITEM = "id string, type string, title string, description string, source_path string, pages array<string>, queries array<string>, resolved boolean, created_at bigint"
_STATE = "id string, title string, description string, source_path string, pages array<string>, queries array<string>, created_at bigint, n_merged bigint"
MERGED = "type string, key string, id string, title string, description string, source_path string, pages array<string>, queries array<string>, created_at bigint, n_merged bigint, pending boolean"


def _union(old: list, new) -> list:
    return list(dict.fromkeys([*old, *([] if new is None else new)]))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = list(state.get) if state.exists else None
    for frame in frames:
        for r in frame.sort_values(["created_at", "id"], kind="stable").itertuples():
            if r.resolved:
                kept = None
            elif kept is None:
                kept = [r.id, r.title, r.description, r.source_path, _union([], r.pages), _union([], r.queries), int(r.created_at), 1]
            else:
                kept = [*kept[:2], r.description or kept[2], r.source_path or kept[3], _union(kept[4], r.pages), _union(kept[5], r.queries), kept[6], kept[7] + 1]
    if kept is None:
        if state.exists:
            state.remove()
        yield pd.DataFrame([(*key, None, None, None, None, [], [], None, 0, False)], columns=[c.split()[0] for c in MERGED.split(", ")])
    else:
        state.update(tuple(kept))
        yield pd.DataFrame([(*key, *kept, True)], columns=[c.split()[0] for c in MERGED.split(", ")])


def merged(items: DataFrame) -> DataFrame:
    """A stream of items (ITEM) as updates of merged ones (MERGED).

    The first pending item of a type and normalised title gives id and title; later ones add
    their pages and queries, and their text and source where they have any. A resolved item ends
    it, so that the next one is new; its update has pending false.
    """
    keyed = items.withColumn("key", normalize_review_title(F.col("title")))
    return keyed.groupBy("type", "key").applyInPandasWithState(_fold, MERGED, _STATE, "update", GroupStateTimeout.NoTimeout)


def drained_and_swept(stream: DataFrame, work: Callable, state: str, checkpoint: str, items: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """Takes in all that waits in the queue; then id and action of the items that the pages now resolve."""
    query: StreamingQuery = queue.start(stream, work, state, checkpoint, every=None)
    query.awaitTermination()
    spark = stream.sparkSession
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "\\.md$", "")
    pages = queue.current_pages(spark, state).select(name.alias("page_id"), F.coalesce(F.nullif(F.regexp_extract("content", "(?m)^title:[ \\t]*[\"']?([^\\n]+?)[\"']?[ \\t]*$", 1), F.lit("")), name).alias("title"))
    return reviews.swept(items(spark), pages)
