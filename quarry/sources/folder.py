"""Folders of files, on any file system that Arrow reads (local, HDFS, S3, GCS), as a Spark data source: batch, stream and sink.

Names that begin with a dot or underscore are files like others.  Links to folders are not followed.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.sources.files import MAX_FILE_SIZE, load_files

FILES = "project string, path string, size long, modified timestamp, content binary"
CHANGES = "project string, path string, ts timestamp, op string, size long, modified timestamp, content string"
STAMP = pa.timestamp("us", tz="UTC")
LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])
#: A partition ends after so many bytes; a small file counts as this many, for the time that it takes to open.
PARTITION_BYTES, OPEN_COST = 64 << 20, 256 << 10
#: Bytes of content in one Arrow batch, about.
BATCH_BYTES = 8 << 20
#: Files of a listing that are sorted in memory, and in a row group of a stored one.
SORTED, GROUP = 100_000, 20_000


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    modified: int
    op: str = "change"


@dataclass
class Files(InputPartition):
    files: list[Found]

    def __init__(self, files: list[Found]):
        self.files = files


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        fs, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    else:
        fs, base = pafs.LocalFileSystem(), os.path.abspath(root)
    return fs, base.rstrip("/")


def listed(root: str, prefixes: list[str] | None = None) -> list[Found]:
    """The files under a folder, in the order of their paths; with prefixes only the folders that can hold such paths are listed."""
    fs, base = opened(root)
    local = isinstance(fs, pafs.LocalFileSystem)

    def wanted(path: str, folder: bool) -> bool:
        return prefixes is None or any(path.startswith(p) or (folder and p.startswith(path + "/")) for p in prefixes)

    out, level = [], [base]
    with ThreadPoolExecutor(16) as pool:
        while level:
            below = []
            for infos in pool.map(lambda at: fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)), level):
                for i in infos:
                    path = i.path[len(base) + 1 :]
                    if i.type == pafs.FileType.Directory:
                        if wanted(path, True) and not (local and os.path.islink(i.path)):
                            below.append(i.path)
                    elif i.type == pafs.FileType.File and wanted(path, False):
                        out.append(Found(path, i.size, (i.mtime_ns or 0) // 1000))
            level = below
    return sorted(out, key=lambda f: f.path)


def walked(root: str) -> Iterator[Found]:
    """The files under a folder, folder by folder in no order.  A local folder is read as it comes; others are given by their file system as one list for each folder."""
    fs, base = opened(root)
    local, level = isinstance(fs, pafs.LocalFileSystem), [base]
    while level:
        at = level.pop()
        if not local:
            for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if i.type == pafs.FileType.Directory:
                    level.append(i.path)
                elif i.type == pafs.FileType.File:
                    yield Found(i.path[len(base) + 1 :], i.size, (i.mtime_ns or 0) // 1000)
            continue
        try:
            entries = os.scandir(at)
        except FileNotFoundError:
            continue
        with entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    level.append(e.path)
                    continue
                try:
                    if e.is_file():
                        st = e.stat()
                        yield Found(e.path[len(base) + 1 :], st.st_size, st.st_mtime_ns // 1000)
                except FileNotFoundError:  # gone since
                    continue


def in_order(files: Iterator[Found], at: str) -> Iterator[Found]:
    """files in the order of their paths; runs of `SORTED` files are sorted in memory and merged from the folder `at`."""
    runs: list[str] = []
    while run := list(islice(files, SORTED)):
        run.sort(key=lambda f: f.path)
        if not runs and len(run) < SORTED:
            yield from run
            return
        runs.append(f"{at}/{len(runs)}")
        with Listing(pafs.LocalFileSystem(), runs[-1], 0) as out:
            for f in run:
                out.add(f)
    yield from heapq.merge(*(held(pafs.LocalFileSystem(), r, small=True) for r in runs), key=lambda f: f.path)


class Listing:
    """A listing as it is written, a row group at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str, listed: int):
        self.rows: list[Found] = []
        self.out = pq.ParquetWriter(path, LISTING.with_metadata({"listed": str(listed)}), filesystem=fs)

    def add(self, f: Found) -> None:
        self.rows.append(f)
        if len(self.rows) >= GROUP:
            self.flush()

    def flush(self) -> None:
        self.out.write_table(pa.table([[f.path for f in self.rows], [f.size for f in self.rows], [f.modified for f in self.rows]], schema=self.out.schema))
        self.rows = []

    def __enter__(self) -> Listing:
        return self

    def __exit__(self, *error) -> None:
        if self.rows:
            self.flush()
        self.out.close()


def held(fs: pafs.FileSystem, path: str, first: str | None = None, last: str | None = None, small: bool = False) -> Iterator[Found]:
    """The files of a stored listing in their order, from the path `first` on and before `last`; only row groups that can hold such are read."""
    with fs.open_input_file(path) as source:
        at = pq.ParquetFile(source)
        for k in range(at.num_row_groups):
            own = at.metadata.row_group(k).column(0).statistics
            if own is not None and own.has_min_max and (first is not None and own.max < first or last is not None and own.min >= last):
                continue
            for b in at.iter_batches(2_000 if small else 10_000, row_groups=[k]):
                if first is not None:
                    b = b.filter(pc.greater_equal(b.column(0), first))
                if last is not None:
                    b = b.filter(pc.less(b.column(0), last))
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    yield Found(*row)


def changed(old: Iterator[Found], new: Iterator[Found]) -> Iterator[tuple[Found | None, Found | None]]:
    """(old, change) by path, of two listings in order: a file that is as it was has no change, one that has gone is a deletion."""
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or a and a.path < b.path:
            yield a, Found(a.path, 0, 0, "delete")
            a = next(old, None)
        elif a is None or b.path < a.path:
            yield None, b
            b = next(new, None)
        else:
            yield a, None if a == b else b
            a, b = next(old, None), next(new, None)


def balanced(files: list[Found], partition_bytes: int = PARTITION_BYTES) -> list[Files]:
    """Runs of files of about equal cost: neighbours in the tree stay together and no partition is much over its bytes unless one file is."""
    out, run, cost = [], [], 0
    for f in files:
        more = f.size + OPEN_COST
        if run and cost + more > partition_bytes:
            out.append(Files(run))
            run, cost = [], 0
        run.append(f)
        cost += more
    return [*out, Files(run)] if run else out


def _contents(root: str, files: Iterator[Found] | list[Found], max_file_size: int) -> Iterator[tuple[Found, bytes | None]]:
    """Each file with its bytes; null for deletions and for files that are too large, nothing for one that has gone since it was listed."""
    fs, base = opened(root)
    for f in files:
        if f.op == "delete" or f.size > max_file_size:
            yield f, None
            continue
        try:
            with fs.open_input_stream(f"{base}/{f.path}") as at:
                yield f, at.read()
        except FileNotFoundError:
            continue


def _batches(rows: Iterator[tuple], schema: pa.Schema, content: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[content] or b"") + 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class FolderReader(DataSourceReader):
    SCHEMA = pa.schema([("project", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", STAMP), ("content", pa.binary())])

    def __init__(self, root: str, project: str, under: list[str] | None, max_file_size: int, partition_bytes: int):
        self.root, self.project, self.under, self.max_file_size, self.partition_bytes = root, project, under, max_file_size, partition_bytes

    def partitions(self):
        return balanced([f for f in listed(self.root, self.under) if f.size <= self.max_file_size], self.partition_bytes)

    def read(self, partition):
        rows = ((self.project, f.path, f.size, f.modified, data) for f, data in _contents(self.root, partition.files if partition else [], self.max_file_size))
        return _batches(rows, self.SCHEMA, 4)


class Changes(InputPartition):
    """What changed between two listings, from a path on and before another."""

    def __init__(self, source: FolderStream, start: int, end: int, first: str, last: str | None):
        self.source, self.start, self.end, self.first, self.last = source, start, end, first, last

    @property
    def files(self) -> list[Found]:
        return list(self.source._told(self.start, self.end, self.first, self.last))


class FolderStream(DataSourceStreamReader):
    """What changed in a folder since the last batch: changed and new files, and deletions.

    An offset is the number of a listing, a Parquet file in the folder `listings`, which says what has been told up to it; so offsets stay small, a batch that is
    run again has the same files, and deletions are seen.  A batch tells all changes or, with `max_files`, so many, in the order of their paths; its listing is then the last one with
    these alone.  Listings before the last batch's are removed once it is committed.  The driver reads the folder and the last listing side by side and holds neither; tasks
    get a range of paths each.
    """

    SCHEMA = pa.schema([("project", pa.string()), ("path", pa.string()), ("ts", STAMP), ("op", pa.string()), ("size", pa.int64()), ("modified", STAMP), ("content", pa.string())])

    def __init__(self, root: str, project: str, listings: str, max_file_size: int, partition_bytes: int, max_files: int | None):
        self.root, self.project, self.listings = root, project, listings
        self.max_file_size, self.partition_bytes, self.max_files = max_file_size, partition_bytes, max_files

    def _names(self) -> list[int]:
        fs, base = opened(self.listings)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted(int(i.base_name.split(".")[0]) for i in found if i.base_name.split(".")[0].isdigit())

    def _held(self, n: int, first: str | None = None, last: str | None = None) -> Iterator[Found]:
        """A listing, or the part of it from a path to another; number 0 is that of an empty folder."""
        if n == 0:
            return iter(())
        fs, base = opened(self.listings)
        return held(fs, f"{base}/{n}.parquet", first, last)

    def _listed(self, n: int) -> int:
        """The time at which a listing was made."""
        if n == 0:
            return 0
        fs, base = opened(self.listings)
        return int(pq.read_schema(f"{base}/{n}.parquet", filesystem=fs).metadata[b"listed"])

    def _told(self, start: int, end: int, first: str | None = None, last: str | None = None) -> Iterator[Found]:
        listed = self._listed(end)
        for _, f in changed(self._held(start, first, last), self._held(end, first, last)):
            if f is not None:
                yield Found(f.path, f.size, f.modified or listed, f.op)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last, told = (self._names() or [0])[-1], 0
        fs, base = opened(self.listings)
        fs.create_dir(base, recursive=True)
        part = f"{base}/part-{uuid.uuid4().hex}"
        with tempfile.TemporaryDirectory(prefix="listing-") as runs:
            with Listing(fs, part, int(time.time() * 1_000_000)) as out:
                for was, f in changed(self._held(last), in_order(walked(self.root), runs)):
                    if f is not None and (self.max_files is None or told < self.max_files):
                        told += 1
                        was = None if f.op == "delete" else f
                    if was is not None:
                        out.add(was)
        if not told:
            fs.delete_file(part)
            return {"listing": last}
        fs.move(part, f"{base}/{last + 1}.parquet")  # under its name it is whole
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict):
        """Ranges of paths, whose files the tasks take from the listings themselves."""
        out, first, cost = [], None, 0
        for f in self._told(start["listing"], end["listing"]):
            more = f.size + OPEN_COST
            if first is None or cost + more > self.partition_bytes:
                if first is not None:
                    out.append((first, f.path))
                first, cost = f.path, 0
            cost += more
        return [Changes(self, start["listing"], end["listing"], *x) for x in ([*out, (first, None)] if first is not None else [])]

    def read(self, partition):
        def text(data: bytes | None) -> str | None:
            try:
                return None if data is None else data.decode("utf-8")
            except UnicodeDecodeError:
                return None

        told = self._told(partition.start, partition.end, partition.first, partition.last)
        rows = ((self.project, f.path, f.modified, f.op, f.size, None if f.op == "delete" else f.modified, text(data)) for f, data in _contents(self.root, told, self.max_file_size))
        return _batches(rows, self.SCHEMA, 6)

    def commit(self, end: dict) -> None:
        fs, base = opened(self.listings)
        for n in self._names():
            if n < end["listing"]:
                fs.delete_file(f"{base}/{n}.parquet")


class FolderWriter(DataSourceWriter):
    """Each row (path, content) becomes a file; a task that runs again writes the same files again.  Null content is skipped."""

    def __init__(self, root: str, at: list[str]):
        self.root, self.path, self.content = root, at.index("path"), at.index("content")

    def write(self, iterator):
        fs, base = opened(self.root)
        made = set()
        for r in iterator:
            if r[self.content] is None:
                continue
            to = f"{base}/{r[self.path]}"
            folder = to.rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            data = r[self.content]
            part = f"{base}/.part-{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(data.encode() if isinstance(data, str) else bytes(data))
            fs.move(part, to)
        return WriterCommitMessage()


class FolderRemover(FolderWriter):
    """Each row's path is removed; one that is not there is none."""

    def __init__(self, root: str, at: list[str]):
        self.root, self.path = root, at.index("path")

    def write(self, iterator):
        fs, base = opened(self.root)
        for r in iterator:
            try:
                fs.delete_file(f"{base}/{r[self.path]}")
            except FileNotFoundError:
                continue
        return WriterCommitMessage()


class FolderSource(DataSource):
    """Options: path, project, max_file_size, partition_bytes; for batches under (a JSON list of path prefixes); for sinks remove; for streams listings (a shared folder) and max_files."""

    @classmethod
    def name(cls) -> str:
        return "quarry_folder"

    def schema(self) -> str:
        return CHANGES if "listings" in self.options else FILES

    def _common(self) -> tuple[int, int]:
        return int(self.options.get("max_file_size", MAX_FILE_SIZE)), int(self.options.get("partition_bytes", PARTITION_BYTES))

    def reader(self, schema) -> FolderReader:
        under = json.loads(self.options.get("under", "null"))
        return FolderReader(self.options["path"], self.options.get("project"), under, *self._common())

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options["path"], self.options.get("project"), self.options["listings"], *self._common(), int(self.options["max_files"]) if "max_files" in self.options else None)

    def writer(self, schema, overwrite) -> FolderWriter:
        kind = FolderRemover if self.options.get("remove") == "true" else FolderWriter
        return kind(self.options["path"], schema.names)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FolderSource)
    return spark


def read_folder(spark: SparkSession, root: str, project: str, under: list[str] | None = None, max_file_size: int = MAX_FILE_SIZE, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The files under a folder, as load_files gives them; larger files are left out.  With `under`, paths that begin with one of these prefixes, and only
    folders that can hold such are listed.  The driver holds the listing (names and sizes), as with Spark's own file sources; `scan_files` lists in tasks."""
    at = _registered(spark).read.format("quarry_folder").options(project=project, under=json.dumps(under), max_file_size=max_file_size, partition_bytes=partition_bytes)
    return load_files(at.load(root))


def watch_folder(spark: SparkSession, root: str, project: str, listings: str, max_files: int | None = None, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """A stream of changes, as filter_changes, debounce and maintain_index take them.  `listings` belongs to one stream, like its checkpoint.  A file over the
    size limit has null content (filter_changes makes it a deletion), and so has one that is not UTF-8.  A batch tells all changes, in partitions of bounded
    bytes; with `max_files` at most so many, and a run with availableNow is one batch, so the rest waits for the next run."""
    at = _registered(spark).readStream.format("quarry_folder").options(project=project, listings=listings, max_file_size=max_file_size, **({} if max_files is None else {"max_files": max_files}))
    return at.load(root)


def write_folder(files: DataFrame, root: str) -> None:
    """Writes each (path, content) as a file under root; files that are there are replaced, others stay."""
    _registered(files.sparkSession)
    files.select("path", "content").write.format("quarry_folder").mode("append").save(root)


def delete_files(files: DataFrame, root: str) -> None:
    """Removes each path under root, as far as it is there."""
    _registered(files.sparkSession)
    files.select("path").write.format("quarry_folder").option("remove", "true").mode("append").save(root)
