from pyspark.sql import functions as F

from quillspark.streaming import queue, reviews

ROWS = [
    ("1", "duplicate", "Duplicate page: RoPE", "old", None, ["a.md"], ["q1"], False, 1),
    ("2", "duplicate", "RoPE", "", "s.pdf", ["b.md", "a.md"], None, False, 2),
    ("3", "confirm", "RoPE", "other", None, None, None, False, 3),
    ("4", "duplicate", "rope", "new", None, ["c.md"], ["q1", "q2"], False, 4),
]


def test_pending_reviews_are_merged_over_batches(spark, tmp_path):
    folder, name = str(tmp_path / "in"), "merged_reviews"
    stream = spark.readStream.schema(reviews.ITEM).parquet(folder + "/*")

    def run(k, rows):
        spark.createDataFrame(rows, reviews.ITEM).coalesce(1).write.parquet(f"{folder}/{k}")
        out = reviews.merged(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(k)))).trigger(availableNow=True).start()
        out.awaitTermination()
        return {(r.type, r.key): r for r in spark.read.parquet(str(tmp_path / "out" / str(k))).collect()}

    first = run(0, ROWS[:2])
    assert len(first) == 1
    got = run(1, ROWS[2:])
    assert {t for t, _ in got} == {"duplicate", "confirm"}
    one = next(r for (t, _), r in got.items() if t == "duplicate")
    assert (one.id, one.title, one.description, one.source_path) == ("1", "Duplicate page: RoPE", "new", "s.pdf")
    assert one.pages == ["a.md", "b.md", "c.md"] and one.queries == ["q1", "q2"] and one.n_merged == 3 and one.pending
    ended = run(2, [("4", "duplicate", "rope", "", None, None, None, True, 5)])
    assert [r.pending for r in ended.values()] == [False]
    again = run(3, [("5", "duplicate", "Rope", "fresh", None, ["z.md"], None, False, 6)])
    assert [(r.id, r.n_merged, r.pages) for r in again.values()] == [("5", 1, ["z.md"])]


def test_reviews_are_swept_when_the_queue_is_empty(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    spark.createDataFrame([("p", "s.md", "text", None)], "project_id string, source string, content string, added_at timestamp").write.json(inbox)

    def work(rows):
        files = F.array(F.struct(F.lit("wiki/new-page.md").alias("path"), F.lit("---\ntitle: New Page\n---\n").alias("content")))
        return rows.withColumn("files", files).withColumn("error", F.lit(None).cast("string"))

    items = lambda s: s.createDataFrame([("1", "missing-page", "Missing page: New Page", "", None, [], [], False, 1), ("2", "missing-page", "Missing page: Other", "", None, [], [], False, 2)], reviews.ITEM)
    got = reviews.drained_and_swept(queue.inbox(spark, inbox), work, str(tmp_path / "state"), str(tmp_path / "cp"), items)
    assert [(r.id, r.action) for r in got.collect()] == [("1", "page-exists")]
