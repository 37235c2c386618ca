"""Data sources over checkouts stored as ``<root>/<project_id>/<path>``: a pruned listing, and a committed sink.

`CheckoutSource` lists paths. Excluded directories are not entered, and filters on project_id and path reach
the walk. Contents are read afterwards, for the paths that are wanted only, by tasks that share them evenly. `TreeSink` stores
files so that a repeated or failed task attempt leaves nothing that a reader would see.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    Not,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, StructField, StructType

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.workers import importable
from shiftgauge.operators.files import ScanConfig

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LISTING = "project_id string, path string, bytes long, modified long"
#: Rows of a listing, and bytes of contents, that a task hands over at a time.
BATCH_ROWS, BATCH_BYTES = 10_000, 32_000_000
#: Tasks that list projects at most; projects are dealt over them.
MOST_TASKS = 10_000


def _filesystem(location: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and folder of a location: a path, or a URI that Arrow knows."""
    if ":/" in location:
        files, folder = pafs.FileSystem.from_uri(location)
        return files, folder.rstrip("/")
    return pafs.LocalFileSystem(), os.path.abspath(location)


def _prepared(spark: SparkSession) -> None:
    """Register the sources, and let the tasks import this package from where the driver has it."""
    importable(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CheckoutSource)
    spark.dataSource.register(TreeSink)


# Listing


@dataclass
class Projects(InputPartition):
    names: tuple[str, ...]


@dataclass
class Wanted:
    """What a walk has to visit: conditions that a path must meet, and directories that it need not enter."""

    exclude: tuple[str, ...] = ()
    hidden: bool = True
    projects: frozenset[str] | None = None
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    paths: frozenset[str] | None = None
    not_starts: tuple[str, ...] = ()

    def enters(self, folder: str) -> bool:
        """Whether a directory, given as path with a slash at its end, can hold a wanted file."""
        rooted = f"/{folder}"
        if any(f"/{d}/" in rooted for d in self.exclude) or not self.hidden and "/." in rooted:
            return False
        if any(folder.startswith(s) for s in self.not_starts):
            return False
        if any(not (folder.startswith(s) or s.startswith(folder)) for s in self.starts):
            return False
        return self.paths is None or any(p.startswith(folder) for p in self.paths)

    def takes(self, path: str) -> bool:
        return (
            (self.hidden or "/." not in f"/{path}")
            and all(path.startswith(s) for s in self.starts)
            and all(path.endswith(s) for s in self.ends)
            and not any(path.startswith(s) for s in self.not_starts)
            and (self.paths is None or path in self.paths)
        )


class CheckoutReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.tasks = int(options.get("tasks", MOST_TASKS))
        exclude = tuple(d.strip("/") for d in json.loads(options.get("exclude", "[]")))
        self.wanted = Wanted(tuple(d for d in exclude if d), options.get("hidden", "true") == "true")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, lists, beginnings and endings; what a walk cannot answer is left to Spark."""
        w = self.wanted

        def both(old: frozenset[str] | None, new: Iterable[str]) -> frozenset[str]:
            return frozenset(new) if old is None else old & frozenset(new)

        for f in filters:
            match f:
                case EqualTo(("project_id",), str(name)):
                    w.projects = both(w.projects, [name])
                case In(("project_id",), names):
                    w.projects = both(w.projects, names)
                case EqualTo(("path",), str(path)):
                    w.paths = both(w.paths, [path])
                case In(("path",), paths):
                    w.paths = both(w.paths, paths)
                case StringStartsWith(("path",), start):
                    w.starts += (start,)
                case StringEndsWith(("path",), end):
                    w.ends += (end,)
                case Not(StringStartsWith(("path",), start)):
                    w.not_starts += (start,)
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        """Projects, dealt over tasks. A project is listed by one task; its contents are not read here."""
        files, folder = _filesystem(self.root)
        found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        names = sorted(x.base_name for x in found if x.type == pafs.FileType.Directory)
        if self.wanted.projects is not None:
            names = [n for n in names if n in self.wanted.projects]
        n = min(self.tasks, len(names))
        return [Projects(tuple(names[i::n])) for i in range(n)] or [Projects(())]

    def read(self, partition: Projects) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(self.root)
        rows: list[tuple] = []
        for name in partition.names:
            for found in walk(files, f"{folder}/{name}", self.wanted):
                rows.append((name, *found))
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows, LISTING_SCHEMA)
                    rows = []
        if rows:
            yield _batch(rows, LISTING_SCHEMA)


LISTING_SCHEMA = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def walk(files: pafs.FileSystem, folder: str, wanted: Wanted) -> Iterator[tuple[str, int, int | None]]:
    """Path below the folder, size and time of change in ns of every wanted file; one directory is listed at a time."""
    todo = [""]
    while todo:
        inner = todo.pop()
        for x in files.get_file_info(pafs.FileSelector(f"{folder}/{inner}".rstrip("/"))):
            path = inner + x.base_name
            if x.type == pafs.FileType.Directory:
                if wanted.enters(path + "/"):
                    todo.append(path + "/")
            elif x.type == pafs.FileType.File and wanted.takes(path):
                yield path, x.size, x.mtime_ns


class CheckoutSource(DataSource):
    """Options: path (the root), exclude (JSON list of directories), hidden (true or false), tasks."""

    @classmethod
    def name(cls) -> str:
        return "checkouts"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> CheckoutReader:
        return CheckoutReader(dict(self.options))


def list_checkouts(spark: SparkSession, root: str, config: ScanConfig | None = None, tasks: int = MOST_TASKS) -> DataFrame:
    """project_id, path, bytes, modified of the files of all checkouts.

    With a configuration, hidden directories and those that it excludes are not entered, as for
    `is_walked`. Filter the result by project_id, or by the beginning, end or value of path, to list less. Turns
    filters on Python sources on for the session. A missing root has no files.
    """
    _prepared(spark)
    reader = spark.read.format("checkouts").option("tasks", str(tasks))
    if config is not None:
        reader = reader.option("exclude", json.dumps([*config.exclude, *fixed.VCS_DIRS])).option("hidden", "false")
    return reader.load(root)


def read_contents(listed: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """The listed files with their content in place of bytes and modified; only these are opened, other columns stay.

    The narrow listing is dealt by path first, so that a project with a third of all files is read by all tasks. A file
    that is gone by then is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(root)
        for batch in batches:
            contents, held, start = [], 0, 0
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{folder}/{name}/{path}") as stream:
                    contents.append(stream.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield batch.slice(start, len(contents)).append_column("content", pa.array(contents, pa.binary()))
                    contents, held, start = [], 0, start + len(contents)
            if contents:
                yield batch.slice(start, len(contents)).append_column("content", pa.array(contents, pa.binary()))

    importable(listed.sparkSession)
    keys = ["project_id", "path"]
    narrow = listed.select(*keys, *[c for c in listed.columns if c not in (*keys, "bytes", "modified", "content")])
    dealt = narrow.repartition(tasks, *keys) if tasks else narrow.repartition(*keys)
    schema = StructType([*narrow.schema.fields, StructField("content", BinaryType())])
    return dealt.mapInArrow(read, schema).withColumn("content", F.col("content").cast("string"))


def read_checkouts(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """Files with content, excluded directories left out. To read fewer, filter `list_checkouts` and read its contents."""
    return read_contents(list_checkouts(spark, root, config), root)


# Sink


@dataclass
class Written(WriterCommitMessage):
    """The file that one task attempt wrote, below `data`; none for a task without rows."""

    file: str | None
    rows: int


class TreeWriter(DataSourceArrowWriter):
    """Every attempt writes a file of its own name; the commit lists the files of the attempts that count."""

    def __init__(self, location: str, overwrite: bool):
        self.location, self.overwrite = location, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _filesystem(self.location)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                files.create_dir(f"{folder}/data", recursive=True)
                out = pq.ParquetWriter(f"{folder}/data/{name}", batch.schema, filesystem=files, compression="zstd")
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _filesystem(self.location)
        number, before = _newest(files, folder)
        new = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file]
        commit = {"files": new if self.overwrite else before + new}
        files.create_dir(f"{folder}/commits", recursive=True)
        draft = f"{folder}/{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(commit).encode())
        files.move(draft, f"{folder}/commits/{number + 1:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _filesystem(self.location)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{folder}/data/{m.file}")


def _newest(files: pafs.FileSystem, folder: str) -> tuple[int, list[dict]]:
    """Number of the newest commit, and the files that count since; 0 and none before the first."""
    found = files.get_file_info(pafs.FileSelector(f"{folder}/commits", allow_not_found=True))
    names = sorted(x.base_name for x in found if x.base_name.endswith(".json"))
    if not names:
        return 0, []
    with files.open_input_stream(f"{folder}/commits/{names[-1]}") as stream:
        return int(names[-1].removesuffix(".json")), json.loads(stream.read())["files"]


class TreeSink(DataSource):
    """Options: path. Modes: append, overwrite (the files of earlier commits no longer count)."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite)


def write_committed(df: DataFrame, location: str, mode: str = "overwrite") -> None:
    """Store rows of any columns where they were computed. Readers see all of them, or none."""
    _prepared(df.sparkSession)
    df.write.format("committed_files").mode(mode).save(location)


def read_committed(spark: SparkSession, location: str, schema: str | StructType) -> DataFrame:
    """The rows of the commits that count; files of failed, repeated and unfinished attempts are not read."""
    files, folder = _filesystem(location)
    _, listed = _newest(files, folder)
    if not listed:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{location.rstrip('/')}/data/{x['file']}" for x in listed])
