"""The queue as keyed state: order, tries, cancelling, restarts, and what tables show."""

import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import tasks

NUMBERS = itertools.count()


class Folder:
    def __init__(self, spark, path):
        self.spark, self.inbox, self.state, self.checkpoint = spark, f"{path}/inbox", f"{path}/state", f"{path}/checkpoint"
        os.makedirs(self.inbox)

    def tell(self, *events):
        """Events as (project, kind, task), one file."""
        rows = [{"project_id": p, "kind": k, "task_id": t, "source": f"raw/{t}.md", "at": n} for n, (p, k, t) in enumerate(events)]
        with open(f"{self.inbox}/{next(NUMBERS):06}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))

    def drain(self, work, **rules):
        tasks.drained(self.spark, self.inbox, self.state, self.checkpoint, work, **rules)

    def once(self, work, **rules):
        """Takes in the events that are there; what runs has no result yet."""
        tasks.start(tasks.moves(tasks.events(self.spark, self.inbox, self.state), **rules), work, self.state, self.checkpoint, every=None).awaitTermination()

    def pages(self):
        return sorted((r.project_id, r.task_id, r.path) for r in tasks.visible(self.spark, self.state).collect())

    def outcomes(self):
        return {r.task_id: (r.status, r.attempts, r.error) for r in tasks.outcomes(self.spark, self.state).collect()}

    def ran(self):
        """(task, attempt) of the moves in the order of batches."""
        rows = tasks._read(self.spark, f"{self.state}/moves", tasks.MOVE).where("kind = 'run'").orderBy("batch", "project_id").collect()
        return [(r.task_id, r.attempt) for r in rows]


def work(todo):
    """Tasks named bad fail, empty ones give nothing, flaky ones do at first; the others write two pages."""
    page = lambda end: F.struct(F.concat(F.lit("wiki/"), "task_id", F.lit(end)).alias("path"), F.concat("source", F.lit(f" {end} "), F.col("attempt").cast("string")).alias("content"))
    both = F.array(page(".md"), page("-2.md"))
    idle = F.contains("task_id", F.lit("empty")) | F.contains("task_id", F.lit("flaky")) & (F.col("attempt") == 1)
    return todo.withColumn("files", F.when(~idle & ~F.contains("task_id", F.lit("bad")), both)).withColumn("error", F.when(F.contains("task_id", F.lit("bad")), "broken"))


@pytest.fixture
def folder(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a batch starts a worker for each
    yield Folder(spark, str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_first_come_first_served_and_tried_thrice(folder):
    folder.tell(("p", "add", "a"), ("p", "add", "bad"), ("p", "add", "c-flaky"), ("p", "add", "d"), ("q", "add", "e-empty"), ("q", "add", "f"))
    folder.drain(work)
    p = [r for r in folder.ran() if r[0] in ("a", "bad", "c-flaky", "d")]
    assert p == [("a", 1), ("bad", 1), ("bad", 2), ("bad", 3), ("c-flaky", 1), ("c-flaky", 2), ("d", 1)]
    assert folder.outcomes() == {
        "a": ("done", 1, None), "bad": ("failed", 3, "broken"), "c-flaky": ("done", 2, None), "d": ("done", 1, None),
        "e-empty": ("failed", 3, tasks.NO_OUTPUT), "f": ("done", 1, None),
    }
    assert {t for _, t, _ in folder.pages()} == {"a", "c-flaky", "d", "f"} and len(folder.pages()) == 8
    # a failed task can be tried again; one that is done isn't known any more
    folder.tell(("p", "retry", "bad"), ("p", "retry", "a"))
    folder.drain(work)
    assert folder.outcomes()["bad"] == ("failed", 4, "broken") and folder.outcomes()["a"] == ("done", 1, None)


def test_cancelled_in_the_middle_and_restarted(folder):
    folder.tell(("p", "add", "a"), ("p", "add", "b"), ("p", "add", "c"), ("q", "add", "d"))
    folder.once(work)  # a and d have written, nothing is committed
    assert folder.spark.read.parquet(f"{folder.state}/pages").count() == 4 and folder.pages() == []
    folder.tell(("p", "cancel", "a"), ("p", "cancel", "c"), ("q", "cancel", "nothing"))
    folder.drain(work)  # a new query from the checkpoint
    assert {t for _, t, _ in folder.pages()} == {"b", "d"}
    assert {k: v[0] for k, v in folder.outcomes().items()} == {"a": "cancelled", "b": "done", "c": "cancelled", "d": "done"}
    cache = tasks.visible(folder.spark, folder.state, "cache", "project_id string, task_id string, seq bigint, attempt int, source string, paths array<string>")
    assert {r.task_id for r in cache.collect()} == {"b", "d"}
    folder.tell(("q", "withdraw", "d"))
    folder.drain(work)
    assert {t for _, t, _ in folder.pages()} == {"b"}
    folder.tell(("q", "add", "d"))  # and again
    folder.drain(work)
    assert {t for _, t, _ in folder.pages()} == {"b", "d"}


def test_cancel_all_keeps_failed_tasks(folder):
    folder.tell(("p", "add", "bad"))
    folder.drain(work)
    folder.tell(("p", "add", "a"), ("p", "add", "b"))
    folder.once(work)
    folder.tell(("p", "cancel_all", None))
    folder.drain(work)
    assert folder.pages() == [] and {k: v[0] for k, v in folder.outcomes().items()} == {"bad": "failed", "a": "cancelled", "b": "cancelled"}
    folder.tell(("p", "retry", "bad"))
    folder.drain(work)
    assert folder.outcomes()["bad"] == ("failed", 4, "broken")


def test_a_batch_that_broke_leaves_nothing_double(folder):
    folder.tell(("p", "add", "a"), ("p", "add", "b"))
    broken = []

    def cache(done):
        if not broken:
            broken.append(1)
            raise RuntimeError("crash between two tables")
        return tasks._cache(done)

    tables = {"pages": tasks._pages, "cache": cache}
    with pytest.raises(Exception, match="crash between"):
        folder.drain(work, tables=tables)
    assert folder.pages() == []
    folder.drain(work, tables=tables)
    assert [t for _, t, _ in folder.pages()] == ["a", "a", "b", "b"]
    assert folder.ran() == [("a", 1), ("b", 1)]


def test_later_commits_win(folder):
    folder.tell(("p", "add", "x"))
    folder.drain(work)
    folder.tell(("p", "withdraw", "none"), ("p", "add", "x"))  # the same source again
    folder.drain(work)
    rows = tasks.current_pages(folder.spark, folder.state).collect()
    assert len(rows) == 2 and len(folder.pages()) == 4


def test_state_holds_open_tasks_only(folder):
    """A hundred batches; what is done leaves the state. Each file adds a task and has the last one's result."""
    for k in range(100):
        rows = [{"project_id": "p", "kind": "add", "task_id": f"t{k}", "source": "s"}]
        rows += [{"project_id": "p", "kind": "result", "task_id": f"t{k - 1}", "seq": k - 1, "attempt": 1, "n_files": 1}] if k else []
        with open(f"{folder.inbox}/{k:03}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
        os.utime(f"{folder.inbox}/{k:03}.json", (k, k))
    stream = tasks.moves(tasks.events(folder.spark, folder.inbox, folder.state, files_per_batch=1))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", folder.checkpoint).foreachBatch(lambda df, n: df.write.parquet(f"{folder.state}/moves/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert query.lastProgress["batchId"] >= 99 and len(sizes) >= 90 and max(sizes) <= 2  # the task that runs, and the number of tasks
    assert {v[0] for k, v in folder.outcomes().items() if k != "t99"} == {"done"} and folder.outcomes()["t99"][0] == "processing"


def test_tasks_without_result_wait_again_after_their_lease(folder):
    """As after a worker's end: the run move is there, its result never comes."""
    folder.tell(("p", "add", "a"))
    lost = lambda todo: work(todo).where("attempt > 1")
    query = tasks.start(tasks.moves(tasks.events(folder.spark, folder.inbox, folder.state), lease=2000), lost, folder.state, folder.checkpoint)
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if os.path.isdir(f"{folder.state}/manifest") and any(p for _, p, _ in folder.pages()):
                break
    finally:
        query.stop()
    assert folder.ran()[:2] == [("a", 1), ("a", 2)] and {t for _, t, _ in folder.pages()} == {"a"}
