from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing


def inverse(u, rate):
    """By exact fractions of exp(-rate), as the sum of rate ** k / k!."""
    u, rate = Decimal(u), Decimal(rate)
    with localcontext() as c:
        c.prec, c.Emin = 60, -(10**6)
        term = cdf = (-rate).exp()
        n = 0
        while cdf <= u:
            n += 1
            term *= rate / n
            cdf += term
    return n


def test_inverse_distribution(spark):
    rows = [(u / 97, r) for u in range(97) for r in (0.0, 0.1, 1.0, 4.5, 30.0)]
    rows += [(u / 7, r) for u in range(1, 7) for r in (700.0, 745.0, 746.0, 800.0, 2000.0, 5000.0)]
    out = spark.createDataFrame(rows, "u double, rate double").withColumn("n", mixing.poisson_inverse(F.col("u"), F.col("rate"))).collect()
    assert all(r.n == inverse(r.u, r.rate) for r in out)
    assert {r.rate: r.n for r in out if r.u == 3 / 7}[2000.0] in range(1980, 2001)


def test_a_rare_source_is_repeated_often(spark):
    docs = spark.createDataFrame([(i, "hot") for i in range(3000)] + [(-1, "rare")], "doc_id bigint, source string")
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mixed(docs, weights=weights).groupBy("source").count().collect()}
    assert n["rare"] == pytest.approx(1500, abs=6 * 1500**0.5) and n["hot"] == pytest.approx(1500, abs=6 * 1500**0.5)


def test_target_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    weights = spark.createDataFrame([("hot", 1.0)] + [(f"s{k}", 1.0) for k in range(5)], "source string, weight double")
    out = mixing.mixed(docs, weights=weights)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert sum(n.values()) == pytest.approx(20_000, rel=0.05)
    for v in n.values():
        assert v == pytest.approx(20_000 / 6, rel=0.1)
    again = mixing.mixed(docs, weights=weights)
    assert out.exceptAll(again).count() == 0


def test_edges(spark):
    rows = [(1, None, "t", 7), (1, None, "t", 7), (None, "a", "t", 7), (2, "a", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, mix_copy int")
    out = mixing.mixed(docs, rate=20.0)
    assert out.columns == ["doc_id", "source", "text", "mix_copy"]
    n = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert set(n) == {(1, None), (None, "a"), (2, "a")} and n[1, None] % 2 == 0
    assert mixing.mixed(docs.where("false")).count() == 0


def test_copies_are_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"))
    out = mixing.mixed(docs, partitions=8)
    sizes = [len(p) for p in out.rdd.glom().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    order = [r.doc_id for r in out.collect()]
    assert order != sorted(order)


def test_rows_without_ids_are_repeated_by_their_rate_and_spread(spark):
    docs = spark.range(10_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    for seed in ("a", "b", "c"):
        assert mixing.mixed(docs, seed=seed, rate=2.0).count() == pytest.approx(20_000, rel=0.05)
    sizes = [len(p) for p in mixing.mixed(docs, partitions=8).rdd.glom().collect()]
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)
    texts = mixing.mixed(docs, rate=3.0).groupBy("text").count().select(F.max("count")).first()[0]
    assert 5 <= texts <= 20
