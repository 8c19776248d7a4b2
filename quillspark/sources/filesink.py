"""Files as a sink: rows of path and content become files below a folder, all of a job or none.

    filesink.register(spark)
    files.select("path", "content").write.format("named_files").option("path", root).option("uploads", "true").mode("append").save()
    filesink.report(spark, root)

Each task writes below a folder of the job's own, beside the files; the job's end moves them to their places, and a job that
fails removes that folder, so that nothing of it is left. Hidden files, and those in hidden folders, are skipped; paths that lead out of
the folder, files over the size cap and, for uploads, files of kinds that aren't allowed are refused one by one, and the
report says why. Of rows with one path one wins, by the order of tasks. Folders are local ones or what pyarrow's file systems reach.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspark.sources.shipping import shipped

# Kinds of files that may be uploaded, and how large a file may be.
ALLOWED = frozenset("pdf xlsx xls docx doc pptx ppt txt md csv json png jpg jpeg gif webp".split())
MOST_MB = 200
REPORT = "path string, size bigint, error string"


def place(path: str | None) -> str | None:
    """path below the folder, with its steps taken; None if it leads out of it or to none."""
    plain = posixpath.normpath((path or "").replace("\\", "/"))
    return None if plain in (".", "..") or plain.startswith(("/", "../")) or plain[1:2] == ":" else plain


def refused(path: str | None, size: int, uploads: bool, most: int) -> str | None:
    """Why a file isn't written, if so."""
    to = place(path)
    if to is None:
        return f"'{path}' is outside the allowed data directory"
    name = to.rsplit("/", 1)[-1]
    end = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
    if uploads and end not in ALLOWED:
        return f"File type '.{end}' is not allowed"
    return f"File exceeds {most // (1 << 20)} MB limit" if size > most else None


def hidden(path: str | None) -> bool:
    return any(p.startswith(".") and p not in (".", "..") for p in (path or "").replace("\\", "/").split("/"))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (path, staged path, size, error) of each file; no staged path for those refused."""

    files: list[tuple[str, str | None, int, str | None]]


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the option path names the folder")
        self.root, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.uploads, self.most = options.get("uploads", "false") == "true", int(float(options.get("mostmb", MOST_MB)) * (1 << 20))

    def write(self, iterator: Iterator) -> Written:
        files, base = _at(self.root)
        own = f"{base}/.staged-{self.job}/{uuid.uuid4().hex}"  # a task that is tried again writes anew
        found: list[tuple[str, str | None, int, str | None]] = []
        for n, row in enumerate(iterator):
            path, content = row[0], row[1]
            data = b"" if content is None else content.encode() if isinstance(content, str) else bytes(content)
            if hidden(path):
                continue
            if error := refused(path, len(data), self.uploads, self.most):
                found.append((path, None, len(data), error))
                continue
            files.create_dir(own, recursive=True)
            with files.open_output_stream(f"{own}/{n}") as out:
                out.write(data)
            found.append((place(path), f"{own}/{n}", len(data), None))
        return Written(found)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves what tasks have written; only names pass through here."""
        files, base = _at(self.root)
        told = [f for m in messages if m for f in m.files]
        for path, staged, _, _ in told:
            if staged:
                files.create_dir(posixpath.dirname(f"{base}/{path}"), recursive=True)
                files.move(staged, f"{base}/{path}")
        files.create_dir(f"{base}/.reports", recursive=True)
        with files.open_output_stream(f"{base}/.reports/{self.job}.json") as out:
            out.write("".join(json.dumps({"path": p, "size": n, "error": e}) + "\n" for p, _, n, e in told).encode())
        self._clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_at(self.root))

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        files.delete_dir_contents(f"{base}/.staged-{self.job}", missing_dir_ok=True)
        if files.get_file_info(f"{base}/.staged-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/.staged-{self.job}")


class NamedFiles(DataSource):
    """Format named_files, for writing path and content. Options: path, uploads (true for the allowed kinds only), mostMb."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema.fields]
        if names[:2] != ["path", "content"]:
            raise ValueError(f"rows have path and content, not {names}")
        return _Writer({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    shipped(spark)
    spark.dataSource.register(NamedFiles)


def saved(files: DataFrame, root: str, uploads: bool = False, most_mb: float = MOST_MB) -> None:
    """Writes files (path, content) below root."""
    register(files.sparkSession)
    files.select("path", "content").write.format("named_files").option("path", root).option("uploads", str(uploads).lower()).option("mostMb", most_mb).mode("append").save()


def report(spark: SparkSession, root: str) -> DataFrame:
    """path, size and error of every file that was to be written below root, of all jobs."""
    return spark.read.schema(REPORT).json(f"{root.rstrip('/')}/.reports/*.json")
