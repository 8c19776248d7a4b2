"""The ingest queue as keyed state: tasks of a project run in order, fail, are tried again, and can be cancelled.

Events (EVENT) come from a folder: add, cancel, cancel_all, retry and withdraw. The state of a project is its
open tasks, those that wait, run or have failed for good, and the number of tasks that it ever had. Moves (MOVE) come out of it: run a task, commit or drop
an attempt, withdraw a task. Each micro-batch does the work of its run moves, writes what it gives below its
own number, and writes a result for each, which a later batch reads as an event.

What an attempt has written is no part of a table until the manifest commits the attempt. The
manifest gets one file a batch, so readers see all tables of an attempt at once or not at all; a cancelled
or failed attempt is dropped and never seen, and withdrawing a task that is done takes it out of all tables at once.
A batch that runs again after a crash replaces its own part of each table.

Within a batch, adds come before cancels, those before results, those before retries: what is cancelled
before its result is seen has none. Events of tasks that aren't open do nothing. A task that is open isn't added again.
Keyed state needs the RocksDB state store; configure() sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RETRIES = 3
IN_FLIGHT = 1
EVENT = "project_id string, kind string, task_id string, source string, at bigint, seq bigint, attempt int, n_files bigint, error string"
MOVE = "project_id string, kind string, task_id string, source string, seq bigint, attempt int, status string, error string"
FILES = "files array<struct<path:string,content:string>>"
_TASK = "seq bigint, source string, status string, tries int, attempt int, error string, started bigint"
_ORDER = {"add": 0, "cancel": 1, "cancel_all": 1, "withdraw": 1, "result": 2, "retry": 3}
NO_OUTPUT = "Ingest produced no output files"


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Queue(StatefulProcessor):
    """Open tasks of a project. lease: milliseconds after which a task without a result waits again; 0 for never."""

    def __init__(self, retries: int = RETRIES, in_flight: int = IN_FLIGHT, lease: int = 0):
        self.retries, self.in_flight, self.lease = retries, in_flight, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", _TASK)
        self.added = handle.getValueState("added", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        project, moves = key[0], []
        open_ = {k[0]: dict(zip([c.split()[0] for c in _TASK.split(", ")], v)) for k, v in self.tasks.iterator()}
        before = {k: dict(v) for k, v in open_.items()}
        for e in sorted(rows, key=lambda r: (_ORDER.get(r.kind, 9), r.at or 0, r.task_id or "")):
            self.take(e, open_, moves)
        self.next(project, open_, moves, timerValues)
        self.store(before, open_)
        yield from (Row(project_id=project, **m) for m in moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        project, moves, now = key[0], [], timerValues.getCurrentProcessingTimeInMs()
        open_ = {k[0]: dict(zip([c.split()[0] for c in _TASK.split(", ")], v)) for k, v in self.tasks.iterator()}
        before = {k: dict(v) for k, v in open_.items()}
        for name, t in open_.items():
            if t["status"] == "processing" and t["started"] + self.lease <= now:
                moves.append(self.move("drop", name, t, "pending"))
                t["status"] = "pending"
        self.next(project, open_, moves, timerValues)
        self.store(before, open_)
        yield from (Row(project_id=project, **m) for m in moves)

    @staticmethod
    def move(kind: str, name: str, task: dict, status: str, error: str | None = None) -> dict:
        return {"kind": kind, "task_id": name, "source": task["source"], "seq": task["seq"], "attempt": task["attempt"], "status": status, "error": error}

    def take(self, e, open_: dict, moves: list) -> None:
        t = open_.get(e.task_id)
        if e.kind == "add" and t is None and e.task_id is not None:
            n = self.added.get()[0] if self.added.exists() else 0
            self.added.update((n + 1,))
            open_[e.task_id] = {"seq": n, "source": e.source, "status": "pending", "tries": 0, "attempt": 0, "error": None, "started": 0}
        elif e.kind == "withdraw" and e.task_id is not None:
            moves.append({"kind": "withdraw", "task_id": e.task_id, "source": None, "seq": None, "attempt": None, "status": "withdrawn", "error": None})
        elif e.kind in ("cancel", "cancel_all"):
            gone = [e.task_id] if e.kind == "cancel" else [k for k, x in open_.items() if x["status"] != "failed"]
            for name in gone:
                if x := open_.pop(name, None):
                    moves.append(self.move("drop", name, x, "cancelled"))
        elif e.kind == "retry" and t and t["status"] == "failed":
            t |= {"status": "pending", "error": None}
        elif e.kind == "result" and t and t["status"] == "processing" and (t["seq"], t["attempt"]) == (e.seq, e.attempt):
            if e.error is None and (e.n_files or 0) > 0:
                moves.append(self.move("commit", e.task_id, t, "done"))
                del open_[e.task_id]
            else:
                t["tries"] += 1
                t |= {"error": e.error or NO_OUTPUT, "status": "failed" if t["tries"] >= self.retries else "pending"}
                moves.append(self.move("drop", e.task_id, t, t["status"], t["error"]))

    def next(self, project: str, open_: dict, moves: list, timers) -> None:
        """Starts the tasks that came first, as many as may run."""
        free = self.in_flight - sum(t["status"] == "processing" for t in open_.values())
        waiting = sorted((t["seq"], k) for k, t in open_.items() if t["status"] == "pending")
        for _, name in waiting[: max(0, free)]:
            t = open_[name]
            now = timers.getCurrentProcessingTimeInMs() if self.lease else 0
            t |= {"status": "processing", "attempt": t["attempt"] + 1, "started": now}
            if self.lease:
                self.handle.registerTimer(now + self.lease)
            moves.append(self.move("run", name, t, "processing"))

    def store(self, before: dict, after: dict) -> None:
        for name in before.keys() - after.keys():
            self.tasks.removeKey((name,))
        for name, t in after.items():
            if before.get(name) != t:
                self.tasks.updateValue((name,), tuple(t.values()))


def events(spark: SparkSession, inbox: str, state: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of events of a folder of JSON files, and of results of earlier batches."""
    def read(path: str) -> DataFrame:
        reader = spark.readStream.schema(EVENT)
        return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)

    return read(inbox).unionByName(read(f"{state}/results/*"))


def moves(stream: DataFrame, retries: int = RETRIES, in_flight: int = IN_FLIGHT, lease: int = 0) -> DataFrame:
    """What is to be done, as a stream of MOVE, from a stream of EVENT."""
    configure(stream.sparkSession)
    processor = Queue(retries, in_flight, lease)
    return stream.groupBy("project_id").transformWithState(processor, MOVE, "update", "ProcessingTime" if lease else "None")


Tables = dict[str, Callable[[DataFrame], DataFrame]]
KEYS = ("project_id", "task_id", "seq", "attempt")


def _pages(done: DataFrame) -> DataFrame:
    return done.select(*KEYS, F.explode("files").alias("f")).select(*KEYS, "f.path", "f.content")


def _cache(done: DataFrame) -> DataFrame:
    return done.select(*KEYS, "source", F.transform("files", lambda f: f["path"]).alias("paths"))


PAGES_AND_CACHE: Tables = {"pages": _pages, "cache": _cache}


def step(work: Callable[[DataFrame], DataFrame], state: str, tables: Tables | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does with its moves.

    work gets KEYS and source of tasks to run, and gives them with files (FILES) and error. tables
    make, of those, the rows to write (KEYS and others), by table.
    """
    tables = PAGES_AND_CACHE if tables is None else tables

    def run(batch: DataFrame, number: int) -> None:
        spark, part = batch.sparkSession, f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{state}/moves/{part}")
        decided = spark.read.schema(MOVE).parquet(f"{state}/moves/{part}")
        counts = {r["kind"]: r["n"] for r in decided.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts.keys() - {"run"}:
            # one file, so that what it says holds at once
            decided.where("kind <> 'run'").coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/{part}")
        if "run" in counts:
            out = f"{state}/outputs/{part}"
            work(decided.where("kind = 'run'").select(*KEYS, "source")).select(*KEYS, "source", "files", "error").write.mode("overwrite").parquet(out)
            done = spark.read.schema(f"project_id string, task_id string, seq bigint, attempt int, source string, {FILES}, error string").parquet(out)
            for name, rows in tables.items():
                rows(done.where("error IS NULL AND size(files) > 0")).write.mode("overwrite").parquet(f"{state}/{name}/{part}")
            n_files = F.coalesce(F.greatest(F.size("files"), F.lit(0)), F.lit(0)).cast("bigint")
            result = done.select("project_id", F.lit("result").alias("kind"), "task_id", "source", F.lit(0).cast("bigint").alias("at"), "seq", "attempt", n_files.alias("n_files"), "error")
            result.write.mode("overwrite").json(f"{state}/results/{part}")

    return run


def start(decided: DataFrame, work: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, tables: Tables | None = None, every: str | None = "0 seconds") -> StreamingQuery:
    """Runs the queue until it is stopped; processAllAvailable() returns when nothing waits any more.

    With every None it takes in the events that are there, and ends.
    """
    writer = decided.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step(work, state, tables))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(spark: SparkSession, inbox: str, state: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], tables: Tables | None = None, **rules) -> None:
    """Works until no task waits or runs; raises what the query fails with."""
    query = start(moves(events(spark, inbox, state), **rules), work, state, checkpoint, tables)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)


def committed(spark: SparkSession, state: str) -> DataFrame:
    """project_id, task_id, attempt and batch of the attempts that tables show."""
    manifest = _read(spark, f"{state}/manifest", MOVE)
    done = manifest.where("kind = 'commit'").groupBy(*KEYS).agg(F.min("batch").alias("batch"))
    gone = manifest.where("kind = 'withdraw'").groupBy("project_id", "task_id").agg(F.max("batch").alias("gone"))
    return done.join(gone, ["project_id", "task_id"], "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("batch"))).drop("gone")


PAGES = "project_id string, task_id string, seq bigint, attempt int, path string, content string"


def visible(spark: SparkSession, state: str, name: str = "pages", schema: str = PAGES) -> DataFrame:
    """The rows of a table that committed attempts have written, with batch, that of the commit."""
    return _read(spark, f"{state}/{name}", schema).drop("batch").join(committed(spark, state), list(KEYS))


def current_pages(spark: SparkSession, state: str) -> DataFrame:
    """The content that was committed last for each path of a project."""
    newest = F.max_by("content", F.struct("batch", "task_id"))
    return visible(spark, state).groupBy("project_id", "path").agg(newest.alias("content"))


def outcomes(spark: SparkSession, state: str) -> DataFrame:
    """project_id, task_id, status, attempts and error of every task that ever ran or was cancelled, as its last move says."""
    rank = F.when(F.col("kind") == "run", 0).otherwise(1)
    last = _read(spark, f"{state}/moves", MOVE).where("kind <> 'withdraw'").groupBy("project_id", "task_id").agg(F.max_by(F.struct("status", "error"), F.struct("batch", "seq", "attempt", rank)).alias("s"), F.max("attempt").alias("attempts"))
    return last.select("project_id", "task_id", "s.status", "attempts", "s.error")
