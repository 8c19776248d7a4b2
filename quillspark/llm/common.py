"""What the operators of this subpackage share: Arrow plumbing, shared storage, tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.sources.shared import stashed  # noqa: F401  operators take it from here
from quillspark.sources.shipping import shipped

#: Rows of one Arrow batch. Texts can be long, so batches are short.
BATCH_ROWS = 256


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches short enough for long texts, and this code on its executors."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appended(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[list], dict[str, list]]],
    fields: list[T.StructField],
    keep: Callable[[dict[str, list]], list[bool]] | None = None,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """df with the columns that make()(values of column) gives for each Arrow batch.

    make runs once a task, so it can set up caches. Columns of df that share a computed
    column's name give way to it; those in without are dropped. With keep, only rows for
    which it is true stay.
    """
    names = {f.name for f in fields} | set(without)
    old = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*old, *fields])
    new = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    kept_names = [f.name for f in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            got = work(batch.column(at[column]).to_pylist())
            arrays = [batch.column(at[n]) for n in kept_names] + [pa.array(got[f.name], f.type) for f in new]
            out = pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*(batch.schema.field(at[n]) for n in kept_names), *new]))
            yield out.filter(pa.array(keep(got), pa.bool_())) if keep else out

    return df.mapInArrow(run, schema)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id, as text, leaves that remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: dict[int, int]) -> DataFrame:
    """(text, label) of at most per_class[label] labelled documents of each class.

    The choice is by a hash of the id, so it doesn't depend on the order of rows. At most
    sum(per_class) ids are broadcast; texts stay where they are read. Of rows with one id the
    least text counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*per_class) & allowed).groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = None
    for value, most in per_class.items():
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        parts = part if parts is None else parts.unionByName(part)
    own = docs.select("doc_id", "text").join(F.broadcast(parts), "doc_id")
    return own.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label")


def log2_ceil(n: int) -> int:
    return max(0, (n - 1).bit_length())


def tokenizer_path(path: str | None = None) -> str:
    """The vocabulary file: the given path, TOKENIZER_FILE, or the installed one."""
    if path or os.environ.get("TOKENIZER_FILE"):
        return path or os.environ["TOKENIZER_FILE"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
