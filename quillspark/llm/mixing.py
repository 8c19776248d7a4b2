"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is its source's
target repetition rate. The variable is the inverse of the distribution function at a
uniform number hashed from seed and id, so any rerun of a task gives the same copies. The
copies are then dealt to partitions and sorted by a hash of their own, which is the global
shuffle; a source never decides where a copy goes.

A source's weight is its number of documents to the power alpha, unless weights are given;
rates are scaled so that the mix has rate copies a document, on average. Null sources count
as a source named ''. A document with a null id has its text's hash for an id, so that documents without ids
are repeated by their source's rate too. Repeated rows are repeated alike; where many lie in one
partition, adaptive execution splits it. No rows give no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stashed

SEED = "mix-1"
ALPHA = 0.7
RATE = 1.0
#: Sources up to this number are broadcast; a row of them takes less than 1 kB.
BROADCAST_SOURCES = 10_000


def identity(docs: DataFrame) -> Column:
    """A document's id as text, or else its text's hash; without a text column rows without an id are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))


def uniform(key: Column) -> Column:
    """52 bits of md5 as a number from 0 up to 1, in every engine the same."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least count whose distribution function exceeds u.

    Terms are kept as logarithms, as those of high rates begin below what a double can hold, and
    summed up to far beyond any count that 52 bits can ask for.
    """
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.log(rate / k)
        return F.when(s["cdf"] > u, s).otherwise(F.struct(log.alias("log"), (s["cdf"] + F.exp(log)).alias("cdf"), k.cast("int").alias("n")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["n"])


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, rate: float = RATE) -> DataFrame:
    """source and the mean number of copies of each of its documents."""
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = stashed(n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha))))
    else:
        n = stashed(n.join(weights.select("source", F.col("weight").cast("double").alias("weight")), "source", "left").na.fill(0.0, ["weight"]))
    total = n.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"]) if total["weight"] else F.lit(0.0)
    return n.select("source", (F.lit(rate) * F.lit(total["n"] or 0) * share / F.col("n")).alias("rate"))


def counted(docs: DataFrame, seed: str = SEED, **mix) -> DataFrame:
    """docs with the number of copies, mix_copies."""
    by_source = rates(docs, **mix).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"))
    if by_source.count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    u = uniform(F.concat(F.lit(f"{seed}:"), identity(docs)))
    joined = docs.join(by_source, F.coalesce("source", F.lit("")) == F.col("mix_source"), "left")
    return joined.withColumn("mix_copies", poisson_inverse(u, F.col("mix_rate"))).drop("mix_source", "mix_rate")


def mixed(docs: DataFrame, seed: str = SEED, partitions: int | None = None, **mix) -> DataFrame:
    """The columns of docs and mix_copy (from 0), a row for each copy, shuffled.

    Input columns named mix_copy, mix_copies, mix_key, mix_source or mix_rate are replaced.
    """
    docs = docs.drop("mix_copy", "mix_copies", "mix_key", "mix_source", "mix_rate")
    copies = (
        counted(docs, seed, **mix)
        .where(F.col("mix_copies") > 0)
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
        .withColumn("mix_key", F.xxhash64(F.lit(seed), identity(docs), "mix_copy"))
        .drop("mix_copies")
    )
    dealt = copies.repartition(partitions, "mix_key") if partitions else copies.hint("rebalance", "mix_key")
    return dealt.sortWithinPartitions("mix_key", "doc_id", "mix_copy").drop("mix_key")
