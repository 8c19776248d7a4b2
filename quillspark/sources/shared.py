"""Shared storage for tables that end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def session_dir(spark: SparkSession) -> str:
    """This application's folder below the session's spark.checkpoint.dir, which all executors share.

    Only a local master, whose executor is the driver, may go without that setting; its folder
    is deleted when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


_SCOPE: ContextVar[str] = ContextVar("scope", default="tables")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables that are stashed inside lie together under that name, so that they can be cleared together."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def stashed(df: DataFrame) -> DataFrame:
    """df, computed once and written to a new path in the session's folder, so that its lineage ends there."""
    spark, path = df.sparkSession, f"{session_dir(df.sparkSession)}/{_SCOPE.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stashed inside are deleted at the end, but for those stashed by the function that this gives."""
    outer = _SCOPE.get()
    own = f"{outer}-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        with scope(outer):
            return stashed(df)

    try:
        with scope(own):
            yield keep
    finally:
        cleared(spark, own)


def cleared(spark: SparkSession, name: str = "") -> None:
    """Deletes what this application has stashed, or of that scope. No result that reads these tables may still be in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{session_dir(spark)}/{name}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
