"""Mailboxes as a data source: ``<root>/<folder>/<validity>/<key>.eml``, read, streamed and written.

A key is a number that grows within a folder while its validity lasts, as mail servers number their
messages. So an offset of a stream is the largest key of each folder, however many messages it holds,
and only files with larger keys are opened. A folder with a new validity starts anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from missiva.sources.mail import header_row

LISTED = "folder string, validity long, key long, path string, size long"
PARSED = "mid string, date string, `from` string, `to` string, subject string, refs array<string>, addrs array<string>, attach boolean"
RAW = "raw binary"
#: Bytes and files that one task reads.
TASK_BYTES, TASK_FILES = 64_000_000, 5_000


@dataclass
class Message:
    folder: str
    validity: int
    key: int
    path: str
    size: int


@dataclass
class Messages(InputPartition):
    files: list[Message]


def _number(text: str) -> int | None:
    return int(text) if text.isdigit() else None


def listing(root: str, folders: Sequence[str] | None = None) -> Iterator[Message]:
    """The messages of a mailbox, or of some of its folders only; files that are named otherwise are none."""
    files, base = fs.FileSystem.from_uri(root)
    below = lambda path, kind: sorted((x for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == kind), key=lambda x: x.base_name)
    for folder in below(base, fs.FileType.Directory):
        if folders is not None and folder.base_name not in folders:
            continue
        for validity in below(folder.path, fs.FileType.Directory):
            if _number(validity.base_name) is None:
                continue
            for file in below(validity.path, fs.FileType.File):
                stem, dot, end = file.base_name.rpartition(".")
                if end == "eml" and dot and _number(stem) is not None:
                    yield Message(folder.base_name, int(validity.base_name), int(stem), file.path, file.size)


def tasks(found: Iterator[Message]) -> list[Messages]:
    """Messages in groups that one task reads."""
    out, size = [], TASK_BYTES
    for m in found:
        if size + m.size > TASK_BYTES or len(out[-1].files) >= TASK_FILES:
            out.append(Messages([]))
            size = 0
        out[-1].files.append(m)
        size += m.size + 4096
    return out or [Messages([])]


def rows(root: str, columns: list[str], part: Messages) -> Iterator[tuple]:
    """The columns of each message; a file is opened only if a header or its text is asked for. Unreadable ones are left out."""
    files, _ = fs.FileSystem.from_uri(root)
    opened = set(columns) - {"folder", "validity", "key", "path", "size"}
    for m in part.files:
        row = dict(vars(m))
        if opened:
            try:
                with files.open_input_stream(m.path) as f:
                    row["raw"] = f.read()
                if opened != {"raw"}:
                    row = header_row(m.path, row["raw"]) | row
            except (LookupError, ValueError, TypeError, AttributeError):
                continue
        yield tuple(row[c] for c in columns)


class Reader(DataSourceReader):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns, self.folders = root, columns, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Folders that are asked for are the only ones listed; other filters stay with Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("folder",):
                self.folders = wanted if self.folders is None else self.folders & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return tasks(listing(self.root, self.folders))

    def read(self, partition: Messages) -> Iterator[tuple]:
        yield from rows(self.root, self.columns, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per folder its newest validity and the largest key in it."""
        last: dict[str, list[int]] = {}
        for m in listing(self.root):
            last[m.folder] = max(last.get(m.folder, [0, 0]), [m.validity, m.key])
        return last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        changed = [f for f in end if end[f] != start.get(f)]
        return tasks(m for m in listing(self.root, changed) if start.get(m.folder, [-1, -1]) < [m.validity, m.key] <= end[m.folder])

    def read(self, partition: Messages) -> Iterator[tuple]:
        yield from rows(self.root, self.columns, partition)


class Writer(DataSourceWriter):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """One file a row; written aside and moved to its name, so that a task that runs again replaces its files whole."""
        files, base = fs.FileSystem.from_uri(self.root)
        made = set()
        for r in iterator:
            folder = f"{base}/{r['folder']}/{r['validity']}"
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            aside = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(aside) as f:
                f.write(bytes(r["raw"]))
            files.move(aside, f"{folder}/{r['key']}.eml")
        return WriterCommitMessage()


class Mailbox(DataSource):
    """``spark.read``, ``readStream`` and ``write`` with ``format("mailbox")``.

    ``schema(...)`` names the columns that are wanted, of ``LISTED``, ``PARSED`` and ``RAW``; without it they
    are the first two. Writers give ``folder, validity, key, raw``.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return f"{LISTED}, {PARSED}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a mailbox is appended to")
        return Writer(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mailbox)
