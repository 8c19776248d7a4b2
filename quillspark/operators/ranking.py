"""Global ranks without a single task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import stashed


def ranked(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with its 1-based place in that order, which must have no ties.

    Rows are dealt by ranges and numbered within each, and written, as the bounds of the ranges
    are sampled anew whenever a plan runs; then only the ranges' sizes meet.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = stashed(numbered.select("*", F.shiftrightunsigned("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")).drop("_id"))
    sizes = dealt.groupBy("_part").agg((F.max("_place") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
