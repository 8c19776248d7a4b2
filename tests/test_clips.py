"""Web clips as a stream, and what the queue makes of them."""

import json
import os

from pyspark.sql import functions as F

from quillspark.streaming import clips, tasks

AT = "2024-05-06T07:08:09Z"


def put(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.write("\n".join(json.dumps(dict(zip(("project_id", "title", "url", "content", "clipped"), r))) for r in rows))


def test_names_over_batches_and_restarts(spark, tmp_path):
    base = str(tmp_path)
    there = spark.createDataFrame([("p", "raw/sources/hello-wörld-20240506-3.md"), ("p", "raw/sources/untitled-20240506.md"), ("p", "raw/sources/other.md"), ("p", "wiki/x-20240506.md")], "project_id string, path string")
    seen = set()

    def run():
        stream = clips.pages(clips.inbox(spark, f"{base}/in"), there)
        clips.start(stream, f"{base}/pages", f"{base}/queue", f"{base}/checkpoint", every=None).awaitTermination()
        rows = spark.read.schema(clips.PAGE).parquet(f"{base}/pages/*").collect()
        new = sorted((r.project_id, r.path, r.url) for r in rows if (r.project_id, r.path) not in seen)
        seen.update((r.project_id, r.path) for r in rows)
        assert len(rows) == len(seen)
        return new

    same = ("p", "Hello, Wörld!", "http://a", "text", AT)
    put(f"{base}/in", "0", [same, ("q", "Hello, Wörld!", "http://a", "text", AT), ("p", None, None, "text", AT), ("p", "empty", "u", "", AT), ("p", "none", "u", None, AT)])
    assert run() == [("p", "raw/sources/hello-wörld-20240506.md", "http://a"), ("p", "raw/sources/untitled-20240506-2.md", ""), ("q", "raw/sources/hello-wörld-20240506.md", "http://a")]
    put(f"{base}/in", "1", [same, ("p", "Hello Wörld", "http://b", "text", AT)])  # the same again, in another batch of another query
    assert run() == [("p", "raw/sources/hello-wörld-20240506-2.md", "http://a"), ("p", "raw/sources/hello-wörld-20240506-4.md", "http://b")]  # 3 is taken
    assert run() == []
    put(f"{base}/in", "2", [same])
    assert run() == [("p", "raw/sources/hello-wörld-20240506-5.md", "http://a")]


def test_a_clip_becomes_a_page_of_the_wiki(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", "0", [("p", 'A "B"', "http://x/?q=\"", "body", AT), ("p", "C", "u", "more", AT)])
    clips.start(clips.pages(clips.inbox(spark, f"{base}/in")), f"{base}/pages", f"{base}/queue", f"{base}/cp", every=None).awaitTermination()
    page = {r.path: r.content for r in spark.read.schema(clips.PAGE).parquet(f"{base}/pages/*").collect()}["raw/sources/a-b-20240506.md"]
    assert page == '---\ntype: clip\ntitle: "A \\"B\\""\nurl: "http://x/?q=\\""\nclipped: 2024-05-06\norigin: web-clip\nsources: []\ntags: [web-clip]\n---\n\n# A "B"\n\nSource: http://x/?q="\n\nbody\n'

    def work(todo):
        raw = spark.read.schema(clips.PAGE).parquet(f"{base}/pages/*").select("project_id", F.col("path").alias("source"), "content")
        files = F.array(F.struct(F.regexp_replace("source", "^raw/", "wiki/").alias("path"), "content"))
        return todo.join(raw, ["project_id", "source"]).withColumn("files", files).withColumn("error", F.lit(None).cast("string"))

    tasks.drained(spark, f"{base}/queue/*", f"{base}/state", f"{base}/cp2", work)
    assert {(r.path, r.content) for r in tasks.current_pages(spark, f"{base}/state").collect() if r.path.endswith("a-b-20240506.md")} == {("wiki/sources/a-b-20240506.md", page)}
