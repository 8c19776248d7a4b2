"""Ingest as a stream: files land in a folder, each text is taken in once, failures are tried again.

State lives in Parquet tables below one folder. Every micro-batch writes under its own number,
so a batch that runs again after a crash replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RETRIES = 3


def inbox(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON rows: project_id, source, content, added_at."""
    schema = "project_id string, source string, content string, added_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


DONE = "project_id string, source string, sha string"
FAILED = "project_id string, source string, content string, sha string, tries int, error string"
PAGES = "project_id string, path string, content string"


def take_in(work: Callable[[DataFrame], DataFrame], state: str) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does.

    work gets new rows (project_id, source, content, sha) and gives a row for each with files, an array of path
    and content, and error. A row without files counts as failed; it is tried again with the
    next batches, RETRIES times in all. Content that was taken in before, by hash, isn't again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = lambda name, schema: _table(spark, f"{state}/{name}", schema).where(F.col("batch") < number) if _has_batch(spark, f"{state}/{name}") else _table(spark, f"{state}/{name}", schema)
        done, failed = earlier("done", DONE), earlier("failed", FAILED)
        new = batch.withColumn("sha", F.sha2("content", 256)).select("project_id", "source", "content", "sha", F.lit(0).alias("tries"))
        keys = ["project_id", "source", "sha"]
        last = failed.groupBy(*keys).agg(F.max("tries").alias("tries"), F.first("content").alias("content")).where(F.col("tries") < RETRIES)
        todo = new.unionByName(last.select("project_id", "source", "content", "sha", "tries")).groupBy(*keys).agg(F.max("tries").alias("tries"), F.first("content").alias("content"))
        todo = todo.join(done.select(keys), keys, "left_anti")
        result = work(todo).persist()
        good = result.where("size(files) > 0")
        at = F.lit(number).cast("bigint").alias("batch")
        _write(good.select("project_id", F.explode("files").alias("f")).select("project_id", "f.path", "f.content", at), f"{state}/pages", number)
        _write(good.select(*keys, at), f"{state}/done", number)
        bad = result.where("NOT coalesce(size(files) > 0, false)").select("project_id", "source", "content", "sha", (F.col("tries") + 1).cast("int").alias("tries"), F.coalesce("error", F.lit("no output")).alias("error"), at)
        _write(bad, f"{state}/failed", number)
        result.unpersist()

    return run


def _has_batch(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _write(df: DataFrame, path: str, number: int) -> None:
    """Replaces the batch's own part only."""
    df.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")


def start(stream: DataFrame, work: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, every: str | None = "3 seconds") -> StreamingQuery:
    """Runs the queue; with every None it takes in what is there, and ends."""
    writer = stream.writeStream.foreachBatch(take_in(work, state)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_pages(spark: SparkSession, state: str) -> DataFrame:
    """The newest content of each path."""
    rows = _table(spark, f"{state}/pages", PAGES)
    return rows.groupBy("project_id", "path").agg(F.max_by("content", "batch").alias("content"))


def summary(tasks: DataFrame) -> DataFrame:
    """Tasks (status) counted by status."""
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def failed_for_good(spark: SparkSession, state: str) -> DataFrame:
    """Sources that were tried RETRIES times in vain."""
    done, failed = _table(spark, f"{state}/done", DONE), _table(spark, f"{state}/failed", FAILED)
    keys = ["project_id", "source", "sha"]
    last = failed.groupBy(*keys).agg(F.max("tries").alias("tries"), F.max_by("error", "tries").alias("error"))
    return last.where(F.col("tries") >= RETRIES).join(done.select(keys), keys, "left_anti")
