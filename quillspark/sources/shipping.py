"""Gives executors this package's code, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after adding the package as a zip file to its Python files, once."""
    sc = spark.sparkContext
    if not getattr(sc, "_quillspark_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "quillspark_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
        sc._quillspark_shipped = True
    return spark
