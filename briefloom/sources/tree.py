"""Live folder trees: a Python data source that lists, and tasks that hash.

Spark's file sources leave out hidden, ``_`` and empty files and follow
symlinks.  ``TreeSource`` lists a mounted tree itself: ignored and hidden
folders are pruned before anyone descends into them, symlinks are skipped, and
everything else is a row.  What can't be read, or is gone by the time it is
looked at, is left out and stops nothing, whether it is a folder or a file.

*Splits.*  The planner opens folders from the root on, breadth first, until it
has ``splits`` of them or has seen ``PLANNED`` entries.  Each folder that it
has not opened is one split, walked by its task with everything below it.  The
files of a folder that it has opened are listed by as many splits as the folder
has ``SLICE`` entries: each takes the names that hash to it, so a folder that
holds most of a tree is no single split.  Tasks yield entries as they meet them
and hold no listing.

*Hashing.*  The listing is stored once and dealt to as many partitions as its
bytes (and ``OPENING`` for each file) fill, by a hash of the path.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from briefloom.functions.paths import DEFAULT_MAX_SIZE_BYTES, IGNORED_DIRS
from briefloom.session import local_path, shared_dir

FORMAT = "briefloom_tree"
PLANNED = 100_000  # entries the planner looks at
SLICE = 2_000  # entries of an opened folder in one split
ROWS = 2_000  # entries in a batch
SPLIT_BYTES = 64 << 20
OPENING = 64 << 10
_ENTRY = "path string, size long, mtime double"
_PRUNED = frozenset(d.lower() for d in IGNORED_DIRS)


@dataclass
class Subtree(InputPartition):
    """A folder with all that is below it."""

    folder: str


@dataclass
class Slice(InputPartition):
    """The files right in a folder whose names hash to ``part`` of ``parts``."""

    folder: str
    part: int
    parts: int


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """The folder's entries, as far as it can be read."""
    try:
        with os.scandir(folder) as it:
            yield from it
    except OSError:
        return


def _descends(e: os.DirEntry) -> bool:
    return e.name.lower() not in _PRUNED and not e.name.startswith(".")


def _is(e: os.DirEntry, kind: str) -> bool:
    try:
        return getattr(e, kind)(follow_symlinks=False)
    except OSError:
        return False


def _row(e: os.DirEntry) -> tuple[str, int, float] | None:
    try:
        st = e.stat(follow_symlinks=False)
    except OSError:
        return None
    return e.path, st.st_size, st.st_mtime


def walk(folder: str) -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime) of every file below ``folder``, one at a time."""
    todo = [folder]
    while todo:
        for e in _entries(todo.pop()):
            if _is(e, "is_dir"):
                if _descends(e):
                    todo.append(e.path)
            elif _is(e, "is_file") and (row := _row(e)):
                yield row


def sliced(folder: str, part: int, parts: int) -> Iterator[tuple[str, int, float]]:
    """The part's files right in ``folder``."""
    for e in _entries(folder):
        if (parts == 1 or xxhash.xxh3_64_intdigest(os.fsencode(e.name)) % parts == part) and _is(e, "is_file") and (row := _row(e)):
            yield row


class TreeReader(DataSourceReader):
    def __init__(self, root: str, splits: int):
        self.root, self.splits = root, splits

    def partitions(self) -> list[InputPartition]:
        os.stat(self.root)  # a root that isn't there is the caller's mistake
        unopened, out, seen = deque([self.root]), [], 0
        while unopened and len(unopened) < self.splits and seen < PLANNED:
            folder, files = unopened.popleft(), 0
            for e in _entries(folder):
                seen += 1
                if not _is(e, "is_dir"):
                    files += 1
                elif _descends(e):
                    unopened.append(e.path)
            parts = -(-files // SLICE)
            out += [Slice(folder, i, parts) for i in range(parts)]
        return out + [Subtree(f) for f in unopened] or [Slice(self.root, 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = (walk(partition.folder) if isinstance(partition, Subtree)
                else sliced(partition.folder, partition.part, partition.parts))
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= ROWS:
                yield _entry_batch(held)
                held = []
        if held:
            yield _entry_batch(held)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    # Names that are no UTF-8 keep their bytes as surrogates inside Python only.
    paths = [r[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace") for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.float64())], ["path", "size", "mtime"])


class TreeSource(DataSource):
    """``spark.read.format("briefloom_tree").option("root", folder)``; option ``splits``, 64 by default."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"], int(self.options.get("splits", "64")))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files under ``root``, stored: a listing is taken once."""
    spark.dataSource.register(TreeSource)
    splits = max(64, 4 * spark.sparkContext.defaultParallelism)
    path = shared_dir(spark, "tree")
    spark.read.format(FORMAT).option("root", root).option("splits", splits).load().write.parquet(path)
    return spark.read.schema(_ENTRY).parquet(path)


def _digest(path: str) -> str | None:
    """Hex digest of a file, read in pieces; None if it can't be read."""
    h = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                h.update(piece)
    except OSError:
        return None
    return h.hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_digest(p) if r else None for p, r in zip(b.column("path").to_pylist(), b.column("read").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), b.column("mtime"), pa.array(found, pa.string())],
                                         ["path", "size", "mtime", "hash"])


def hashed(files: DataFrame, max_size_bytes: int = DEFAULT_MAX_SIZE_BYTES) -> DataFrame:
    """``files`` (path, size, mtime) with ``hash``: null for files over the ceiling (0: none), which no one
    opens, and for those that can't be read."""
    read = F.lit(True) if max_size_bytes <= 0 else F.col("size") <= max_size_bytes
    cost = files.agg(F.sum(F.lit(OPENING) + F.when(read, F.col("size")).otherwise(0))).first()[0] or 0
    parts = max(1, -(-int(cost) // SPLIT_BYTES))
    return (files.withColumn("read", read).repartition(parts, "path")
            .mapInArrow(_digested, "path string, size long, mtime double, hash string"))


def manifest_from_tree(spark: SparkSession, root: str, project_id: str,
                       max_size_bytes: int = DEFAULT_MAX_SIZE_BYTES) -> DataFrame:
    """S1 + S3: the manifest of all files under ``root``; S2 if it is a file.

    Columns: project_id, root, path, size, mtime, hash.  Files over
    ``max_size_bytes`` (unless it is 0 or the root itself) are listed with a
    null hash, as the manifest's size filter drops them without reading.
    Feed the result to ``scan_manifest`` for the remaining filters.
    """
    root = local_path(root)
    root = root if root == "/" else root.rstrip("/")
    st = os.stat(root)
    if stat.S_ISREG(st.st_mode):
        files = hashed(spark.createDataFrame([(root, st.st_size, st.st_mtime)], _ENTRY), 0)
    else:
        files = hashed(list_tree(spark, root), max_size_bytes)
    return files.select(
        F.lit(project_id).alias("project_id"), F.lit(root).alias("root"), "path", "size",
        F.timestamp_seconds("mtime").cast("timestamp_ntz").alias("mtime"), "hash")
