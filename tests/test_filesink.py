"""Files as a sink: whole jobs or nothing, and what is refused."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import filesink, files


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names if "/.reports" not in d}


def test_files_are_written_and_refused_one_by_one(spark, tmp_path):
    rows = [("a.txt", b"one"), ("x/y/b.MD", "é".encode()), ("x/./c.csv", b""), (".hidden.txt", b"h"), ("x/.git/d.txt", b"h"), ("../out.txt", b"o"), ("/abs.txt", b"o"), ("x/../../o.txt", b"o"), ("C:/w.txt", b"o"), ("e.exe", b"e"), ("noext", b"n"), ("big.txt", b"x" * 3000), (None, b"n"), ("null.json", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    root = str(tmp_path / "up")
    filesink.saved(df, root, uploads=True, most_mb=0.002)
    assert tree(root) == {"a.txt": b"one", "x/y/b.MD": "é".encode(), "x/c.csv": b"", "null.json": b""}
    assert sorted(os.listdir(root)) == [".reports", "a.txt", "null.json", "x"]
    told = {r.path: (r.size, r.error) for r in filesink.report(spark, root).collect()}
    assert told["a.txt"] == (3, None) and told["e.exe"][1] == "File type '.exe' is not allowed" and told["noext"][1] == "File type '.' is not allowed" and "exceeds" in told["big.txt"][1]
    assert all("outside" in told[p][1] for p in ("../out.txt", "/abs.txt", "x/../../o.txt", "C:/w.txt", None)) and not any(".git" in str(p) or "hidden" in str(p) for p in told)
    filesink.saved(spark.createDataFrame([("a.txt", "new text"), ("e.exe", "any kind")], "path string, content string"), root)
    assert tree(root)["a.txt"] == b"new text" and tree(root)["e.exe"] == b"any kind"


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "up")
    filesink.saved(spark.createDataFrame([("old.txt", b"old")], "path string, content binary"), root)
    df = spark.range(40).repartition(4).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("a task fails")).cast("binary")).otherwise(F.lit("text").cast("binary")).alias("content"))
    with pytest.raises(Exception, match="a task fails"):
        filesink.saved(df, root)
    assert tree(root) == {"old.txt": b"old"} and sorted(os.listdir(root)) == [".reports", "old.txt"] and filesink.report(spark, root).count() == 1
    with pytest.raises(Exception, match="path and content"):
        filesink.register(spark)
        spark.range(1).write.format("named_files").option("path", root).mode("append").save()


def test_a_folder_is_copied(spark, tmp_path):
    source = tmp_path / "from"
    for name in ("a.md", "sub/b.bin", ".dot", "sub/.dot/c.md"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(name.encode())
    filesink.saved(files.scan(spark, str(source)), str(tmp_path / "to"))
    assert tree(tmp_path / "to") == {"a.md": b"a.md", "sub/b.bin": b"sub/b.bin"}
