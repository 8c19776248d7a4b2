"""Web clips as a stream: each becomes a page whose name is free, and a task of the ingest queue.

Names are kept as keyed state, by project and the name that title and day give: the first clip has the
name itself, later ones -2, -3 and so on, over batches and restarts. Names of files that are there
already can be given. Clips of one batch are numbered by their time, then by address and content.
A batch's clips of one name are in memory together; files_per_batch bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.tasks import configure

CLIP = "project_id string, title string, url string, content string, clipped timestamp"
PAGE = "project_id string, path string, url string, content string, clipped timestamp"
FOLDER = "raw/sources/"


def inbox(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of clips (CLIP) of a folder of JSON files."""
    return spark.readStream.schema(CLIP).option("maxFilesPerTrigger", files_per_batch).json(folder)


def base_name(title: Column, clipped: Column) -> Column:
    """Letters, digits and hyphens of any script, at most 50, and the day."""
    words = F.trim(F.regexp_replace(F.coalesce(title, F.lit("Untitled")), "[^\\p{L}\\p{N} -]", " "))
    return F.concat(F.substring(F.lower(F.regexp_replace(words, "\\s+", "-")), 1, 50), F.lit("-"), F.date_format(clipped, "yyyyMMdd"))


def page_text(title: Column, url: Column, content: Column, clipped: Column) -> Column:
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    title, url = F.coalesce(title, F.lit("Untitled")), F.coalesce(url, F.lit(""))
    return F.format_string(
        '---\ntype: clip\ntitle: "%s"\nurl: "%s"\nclipped: %s\norigin: web-clip\nsources: []\ntags: [web-clip]\n---\n\n# %s\n\nSource: %s\n\n%s\n',
        quoted(title), quoted(url), F.date_format(clipped, "yyyy-MM-dd"), title, url, content,
    )


class Names(StatefulProcessor):
    """Numbers the pages of a name; those that are taken are left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "last int, taken array<int>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last, taken = self.used.get() if self.used.exists() else (0, [])
        self.used.update((last, [*taken, initialState.n]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, taken = self.used.get() if self.used.exists() else (0, [])
        taken = set(taken)
        for r in sorted(rows, key=lambda r: (r.clipped, r.url, r.content)):
            last += 1
            while last in taken:
                last += 1
            yield Row(project_id=r.project_id, path=f"{FOLDER}{r.base}{f'-{last}' if last > 1 else ''}.md", url=r.url, content=r.content, clipped=r.clipped)
        self.used.update((last, sorted(n for n in taken if n > last)))


def taken(paths: DataFrame) -> DataFrame:
    """project_id, base and n of the clips among paths (project_id, path) that are there before the stream begins."""
    name = F.regexp_extract("path", f"^{FOLDER}(.+-\\d{{8}})(?:-(\\d+))?\\.md$", 1)
    n = F.coalesce(F.regexp_extract("path", f"^{FOLDER}(.+-\\d{{8}})(?:-(\\d+))?\\.md$", 2).try_cast("int"), F.lit(1))
    return paths.select("project_id", name.alias("base"), n.alias("n")).where("base <> ''").distinct()


def pages(clips: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """Clips (CLIP) as a stream of pages (PAGE); those without content are left out. there: paths (project_id, path)."""
    configure(clips.sparkSession)
    rows = clips.where(F.coalesce("content", F.lit("")) != "").select(
        "project_id", base_name(F.col("title"), F.col("clipped")).alias("base"), F.coalesce("url", F.lit("")).alias("url"), page_text(F.col("title"), F.col("url"), F.col("content"), F.col("clipped")).alias("content"), "clipped"
    )
    before = None if there is None else taken(there).groupBy("project_id", "base")
    return rows.groupBy("project_id", "base").transformWithState(Names(), PAGE, "update", "None", before)


def start(stream: DataFrame, target: str, queue_inbox: str, checkpoint: str, every: str | None = "3 seconds") -> StreamingQuery:
    """Writes the pages of each batch below target, and a task for each to the queue's inbox (tasks.EVENT); with every None what is there now."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        written = batch.sparkSession.read.schema(PAGE).parquet(f"{target}/batch={number}")
        added = written.select("project_id", F.lit("add").alias("kind"), F.concat(F.lit("clip:"), "path").alias("task_id"), F.col("path").alias("source"), F.unix_millis("clipped").alias("at"))
        added.write.mode("overwrite").json(f"{queue_inbox}/clips-{number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
