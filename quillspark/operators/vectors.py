"""Vector rows of chunks: distance, nearest neighbours, page scores, upsert and delete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import safe_page_id

# How much lower chunks of a page add, and the chunks that a page shows.
TAIL_WEIGHT, SHOWN_CHUNKS = 0.3, 3
#: Query vectors up to this number are broadcast against the scan; more meet the rows in blocks of both.
QUERY_BLOCK, ROW_BLOCK = 512, 50_000
#: Rows of one matrix product.
MATRIX_ROWS = 8192


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null where lengths differ."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def nearest(rows: DataFrame, query: list[float], k: int, vector: str = "vector") -> DataFrame:
    """The k rows nearest to one vector, with distance and score; exhaustive, then top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = rows.withColumn("distance", squared_distance(F.col(vector), q)).where("distance IS NOT NULL")
    return found.withColumn("score", score(F.col("distance"))).orderBy("distance", "chunk_id").limit(k)


class _Nearest:
    """The k nearest rows of each query so far, ties by chunk_id."""

    def __init__(self, ids: list, queries: list, k: int):
        self.k, self.ids = k, ids
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.by_size: dict[int, tuple[list[int], np.ndarray]] = {}
        for size in {len(q) for q in queries if q is not None and None not in q}:
            own = [i for i, q in enumerate(queries) if q is not None and len(q) == size and None not in q]
            self.by_size[size] = own, np.asarray([queries[i] for i in own], "float64").reshape(len(own), size)

    def add(self, chunk_ids: list, vectors: list) -> None:
        for size, (own, q) in self.by_size.items():
            rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == size and None not in v]
            if not rows:
                continue
            x = np.asarray([vectors[i] for i in rows], "float64").reshape(len(rows), size)
            # the product tells which rows are near enough to look at; their distances are summed exactly alike
            xx, qq = (x * x).sum(1), (q * q).sum(1)
            rough = xx[None, :] - 2.0 * (q @ x.T) + qq[:, None]
            slack = 1e-9 * (xx.max() + qq + 1.0)
            last = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] if len(rows) > self.k else np.full(len(own), np.inf)
            for j, i in enumerate(own):
                old = self.best[i]
                bound = min(last[j], old[-1][0] if len(old) == self.k else np.inf) + 2 * slack[j]
                near = np.flatnonzero(~(rough[j] > bound))
                if len(near):
                    d = ((x[near] - q[j]) ** 2).sum(1).tolist()
                    new = old + [(a, chunk_ids[rows[r]]) for a, r in zip(d, near.tolist())]
                    self.best[i] = sorted(new, key=lambda r: (r[0], r[1] is not None, r[1]))[: self.k]

    def rows(self) -> pa.RecordBatch:
        found = [(i, c, d) for i, own in zip(self.ids, self.best) for d, c in own]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in enumerate((pa.int64(), pa.string(), pa.float64()))], names=["query_id", "chunk_id", "distance"])


_FOUND = "query_id bigint, chunk_id string, distance double"


def nearest_batch(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each (query_id, query_vector) its k nearest rows (chunk_id, vector).

    A stated set of queries meets all rows, by matrix products over batches. A block of queries goes to
    every task; if there are more, each block of queries is joined to each block of rows by their
    numbers, so a task has one block of either. A task keeps k for a query before rows move again.
    """
    rows = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "vector")
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "query_vector")
    n = queries.count()
    if n <= QUERY_BLOCK:
        asked = [(r["query_id"], r["query_vector"]) for r in queries.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = _Nearest([i for i, _ in asked], [q for _, q in asked], k)
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= MATRIX_ROWS:
                    table = pa.Table.from_batches(held)
                    near.add(table.column(0).to_pylist(), table.column(1).to_pylist())
                    held = []
            if held:
                table = pa.Table.from_batches(held)
                near.add(table.column(0).to_pylist(), table.column(1).to_pylist())
            yield near.rows()

        found = rows.mapInArrow(run, _FOUND)
    else:
        blocks, parts = -(-n // QUERY_BLOCK), max(1, -(-rows.count() // ROW_BLOCK))
        deal = lambda df, key, n, name, m, other: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        def both(own: pa.Table, asked: pa.Table) -> pa.Table:
            near = _Nearest(asked.column("query_id").to_pylist(), asked.column("query_vector").to_pylist(), k)
            for low in range(0, own.num_rows, MATRIX_ROWS):
                part = own.slice(low, MATRIX_ROWS)
                near.add(part.column("chunk_id").to_pylist(), part.column("vector").to_pylist())
            return pa.Table.from_batches([near.rows()])

        left = deal(rows, "chunk_id", parts, "part", blocks, "block").groupBy("block", "part")
        found = left.cogroup(deal(queries, "query_id", blocks, "block", parts, "part").groupBy("block", "part")).applyInArrow(both, _FOUND)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page_rollup(hits: DataFrame) -> DataFrame:
    """page_id, score and the best chunks of pages, from chunk hits (page_id, chunk_index, chunk_text, score)."""
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "chunk_index")
    few = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= SHOWN_CHUNKS)
    chunks = few.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("nth", "chunk_index", "chunk_text", "score"))).alias("c"))  # SHOWN_CHUNKS of a page
    top = hits.groupBy("page_id").agg(F.max("score").alias("top"), F.sum("score").alias("total"))
    tail = F.least(TAIL_WEIGHT * (F.col("total") - F.col("top")), F.greatest(F.lit(0.0), 1.0 - F.col("top")))
    shown = F.transform("c", lambda c: F.struct(c["chunk_index"].alias("chunk_index"), c["chunk_text"].alias("chunk_text"), c["score"].alias("score")))
    return top.join(chunks, "page_id").select("page_id", (F.col("top") + tail).alias("score"), shown.alias("chunks"))


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored, with the rows of the batch's pages replaced; ids must be safe and lengths those of stored.

    An empty batch changes nothing.
    """
    batch = batch.where(safe_page_id(F.col("page_id"))).withColumn("chunk_id", F.concat_ws("#", "page_id", F.col("chunk_index").cast("string")))
    size = stored.agg(F.max(F.size("vector")).alias("dim"))
    batch = batch.crossJoin(F.broadcast(size)).where(F.coalesce(F.size("vector") == F.col("dim"), F.lit(True))).drop("dim")
    return stored.join(batch.select("page_id").distinct(), "page_id", "left_anti").select(stored.columns).unionByName(batch.select(stored.columns))


def delete_pages(stored: DataFrame, page_ids: DataFrame) -> DataFrame:
    return stored.join(page_ids.select("page_id").distinct(), "page_id", "left_anti").select(stored.columns)


def drop_legacy(spark: SparkSession, table: str) -> int:
    """Drops the table of an earlier layout from the catalog; how many rows it had, 0 if it isn't there."""
    if not spark.catalog.tableExists(table):
        return 0
    n = spark.table(table).count()
    spark.sql("DROP TABLE IDENTIFIER(:t)", args={"t": table})
    return n


def counts(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("page_id").alias("n_pages"))
