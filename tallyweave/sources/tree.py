"""Directory trees as tables: a Data Source that lists every file, and reading, hashing and writing files where they lie."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Folders that the driver lists to deal out the rest; rows of a listing's batch; bytes of a file that are held at a time.
FOLDERS, ROWS, CHUNK = 1000, 4096, 1 << 20
LISTING = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("mtime_ns", LongType()), StructField("inode", LongType())])


def _local(root: str) -> str | None:
    """The folder of a path on this machine (or mounted on all of them); null for one of another store."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", root)
    if scheme and scheme[1] != "file":
        return None
    return re.sub(r"^file:(//)?", "", root) or "/"


def _store(root: str):
    """(Arrow's file system, base path) of another store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


@dataclass(frozen=True)
class Entry:
    path: str
    folder: bool
    size: int = 0
    mtime_ns: int = 0
    inode: int | None = None


def _entries(root: str, folder: str) -> Iterator[Entry]:
    """Folders and regular files in one folder, by name; links are neither, and nothing is hidden."""
    join = lambda name: f"{folder}/{name}" if folder else name
    local = _local(root)
    if local is None:
        from pyarrow import fs

        store, base = _store(root)
        for found in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
            if found.type in (fs.FileType.File, fs.FileType.Directory):
                yield Entry(join(found.base_name), found.type == fs.FileType.Directory, found.size or 0, found.mtime_ns or 0)
        return
    with os.scandir(os.path.join(local, folder)) as found:
        for e in found:
            if e.is_dir(follow_symlinks=False):
                yield Entry(join(e.name), True)
            elif e.is_file(follow_symlinks=False):
                stat = e.stat(follow_symlinks=False)
                yield Entry(join(e.name), False, stat.st_size, stat.st_mtime_ns, stat.st_ino)


@dataclass
class Part(InputPartition):
    """Folders whose own files count, and folders that count with all below them."""

    own: list[str]
    whole: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Part]:
        """A partition for each folder, level by level; once there are FOLDERS of them, folders come with all below."""
        own: list[str] = []
        frontier = deque([""])
        while frontier and len(own) + len(frontier) < FOLDERS:
            folder = frontier.popleft()
            own.append(folder)
            frontier.extend(e.path for e in _entries(self.root, folder) if e.folder)
        below = [list(frontier)[i::FOLDERS] for i in range(min(FOLDERS, len(frontier)))]
        return [Part([f], []) for f in own] + [Part([], part) for part in below]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[Entry] = []
        todo = [*((f, False) for f in partition.own), *((f, True) for f in partition.whole)]
        while todo:
            folder, deep = todo.pop()
            for entry in _entries(self.root, folder):
                if not entry.folder:
                    rows.append(entry)
                elif deep:
                    todo.append((entry.path, True))
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[Entry]) -> pa.RecordBatch:
        for row in rows:
            try:
                row.path.encode()
            except UnicodeEncodeError as e:
                raise ValueError(f"a file's name is not UTF-8: {row.path!r}") from e
        return pa.RecordBatch.from_arrays(
            [pa.array([r.path for r in rows], pa.string()), *(pa.array([getattr(r, n) for r in rows], pa.int64()) for n in ("size", "mtime_ns", "inode"))], LISTING.names
        )


class TreeSource(DataSource):
    """``spark.read.format("file_tree").load(root)``: path (below root), size, mtime_ns, inode of every regular file."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> StructType:
        return LISTING

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), size, mtime_ns, inode of every regular file under ``root``: hidden, empty or oddly named ones too.

    Links are not followed and not listed. Folders are listed by tasks, a partition a folder; the driver holds the names of at
    most some FOLDERS folders and their subfolders. Local and mounted trees are read as such; other stores through Arrow's
    file systems, which show no inode. A name that is not UTF-8 fails the job rather than slip out.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").load(root)


def _chunks(root: str, path: str) -> Iterator[bytes]:
    local = _local(root)
    if local is None:
        store, base = _store(root)
        opened = store.open_input_stream(f"{base}/{path}")
    else:
        opened = open(os.path.join(local, path), "rb")
    with opened as file:
        while chunk := file.read(CHUNK):
            yield chunk


def _with_each(files: DataFrame, root: str, name: str, kind, make) -> DataFrame:
    """``files`` (path) with the column that ``make(chunks)`` gives for each file, made in the tasks that hold the rows."""
    schema = StructType([*files.schema, StructField(name, kind)])
    at = files.columns.index("path")
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = pa.array([make(_chunks(root, p)) for p in part.column(at).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], schema.names)

    return files.mapInArrow(run, schema)


def _digest(chunks: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()


def hash_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path below ``root``) with content_hash (SHA-256, hexadecimal); a file of any size takes CHUNK bytes of memory."""
    return _with_each(files.repartition("path"), root, "content_hash", StringType(), _digest)


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path below ``root``) with content, whole: for files that fit a row (under 2 GB; 64 are held at a time)."""
    return _with_each(files.repartition("path"), root, "content", BinaryType(), b"".join)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Each row's content written to its path below ``root``; path, bytes of what was written, when the result is run.

    A file appears under its name only when it is whole (it is written beside it and moved), so a task may run twice; one that dies
    midway may leave a ``.part`` file. ``root`` is a local folder of one machine or one mounted on all. An absolute path or one with ``..`` fails the job.
    """
    folder = _local(root)
    if folder is None:
        raise ValueError(f"not a local or mounted folder: {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"a path that leaves the folder: {path}")
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                beside = f"{target}.{uuid.uuid4().hex}.part"
                with open(beside, "wb") as file:
                    file.write(content or b"")
                os.replace(beside, target)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")
