"""From raw documents to packed sequences: five operators of the llm subpackage in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents. Stages may
also be chained without writing: none deletes what another's result reads.

Null and empty texts are clean, equal to each other (one stays), have no secrets, and become
one piece with the end token only. Null ids are kept: rows without an id are deduplicated by
their texts like others, mixed alike, and packed under a null id. Null sources are a source of
their own. Of equal rows one stays; of equal ids with different texts each text does. Long texts
are read whole in every stage. Ties are broken by the least id, then by the text's hash. Empty
tables give empty results; without labels of both classes nothing is toxic. More columns, whatever
their names, pass through all but the last stage, but for those of the mixing stage (mix_...).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import mixing, neardup, packing, secrets, toxicity
from quillspark.llm.common import stashed, table, tuned
from quillspark.sources import shared


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, doesn't reject."""
    tuned(spark)
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones."""
    tuned(spark)
    return neardup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind in brackets."""
    tuned(spark)
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate, shuffled."""
    tuned(spark)
    return mixing.mixed(docs).drop("mix_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences."""
    tuned(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Trained scores, sketches and tokens can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir.

    A stage's result and tables are deleted when the next stage's result is written, those of this run only; what
    the last result reads stays until sources.shared.cleared.
    """
    docs, own = table(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with shared.scope(f"{own}-{k}"):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stashed(docs)
        if 0 < k < len(STAGES) - 1:
            shared.cleared(spark, f"{own}-{k - 1}")
    return docs
