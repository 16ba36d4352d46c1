"""The inbox folder as a streaming data source with an offset log of its own.

Spark's file source leaves out empty files and remembers paths alone.  Here a
listing finds every file right in the folder, empty ones included, by path,
modification time and size, so a name that is dropped again is a new arrival.
Arrivals that no earlier listing has are written to the offset log before
their offset is handed out, and an offset is the number of a listing; a
restart, or a micro-batch that is run again, therefore sees the same arrivals.
When Spark has committed a listing, its arrivals that are still in the folder
are kept as known and its log file goes, so the log stays as large as the
folder.

The source yields what is known of a file, never its content: who decides to
take a file reads it.  A file that was written to within the settle time is
looked at once more after it and left to the next listing if it still grows.
An unreadable file is an arrival with an error; one that is gone is none.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from briefloom.session import local_path

FORMAT = "briefloom_inbox"
SETTLE_SECONDS = 0.1
ROWS = 1_000  # arrivals in one split
FIELDS = {"arrival_id": pa.string(), "path": pa.string(), "size": pa.int64(), "mtime_ns": pa.int64(),
          "listed_at": pa.timestamp("us", "UTC"), "error": pa.string()}
SCHEMA = "arrival_id string, path string, size long, mtime_ns long, listed_at timestamp, error string"


class OffsetLog:
    """Numbered listings in a mounted folder; each is written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder

    def _numbers(self, kind: str) -> list[int]:
        try:
            names = os.listdir(self.folder)
        except FileNotFoundError:
            return []
        return sorted(int(n[len(kind) + 1:-5]) for n in names if n.startswith(kind + "-") and n.endswith(".json"))

    def _file(self, kind: str, n: int) -> str:
        return os.path.join(self.folder, f"{kind}-{n:012d}.json")

    def _write(self, kind: str, n: int, rows: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        path = self._file(kind, n)
        with open(path + ".tmp", "w") as f:
            json.dump(rows, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".tmp", path)

    def _read(self, kind: str, n: int) -> list:
        with open(self._file(kind, n)) as f:
            return json.load(f)

    def last(self) -> int:
        return max([0, *self._numbers("listing"), *self._numbers("known")])

    def append(self, rows: list) -> int:
        n = self.last() + 1
        self._write("listing", n, rows)
        return n

    def rows(self, start: int, end: int) -> list:
        """Rows of the listings behind ``start`` up to ``end``."""
        return [r for n in self._numbers("listing") if start < n <= end for r in self._read("listing", n)]

    def known(self) -> set[str]:
        """Ids of the arrivals that some listing has and the folder may still hold."""
        kept = self._numbers("known")
        ids = set(self._read("known", kept[-1])) if kept else set()
        return ids | {r[0] for r in self.rows(kept[-1] if kept else 0, self.last())}

    def commit(self, end: int, present: set[str]) -> None:
        """Listings up to ``end`` are done: of their arrivals only those still ``present`` are kept."""
        kept = self._numbers("known")
        if kept and kept[-1] >= end:
            return
        ids = set(self._read("known", kept[-1])) if kept else set()
        ids |= {r[0] for r in self.rows(kept[-1] if kept else 0, end)}
        self._write("known", end, sorted(ids & present))
        for kind, n in [("listing", n) for n in self._numbers("listing") if n <= end] + [("known", n) for n in kept]:
            os.remove(self._file(kind, n))


def _arrival(path: str, st: os.stat_result) -> str:
    return hashlib.sha256(f"{path}|{st.st_mtime_ns}|{st.st_size}".encode("utf-8", "surrogateescape")).hexdigest()


def _files(folder: str) -> dict[str, os.stat_result]:
    """The files right in ``folder`` (a link to a file is one), as far as it can be read."""
    out = {}
    try:
        with os.scandir(folder) as it:
            for e in it:
                try:
                    if e.is_file():
                        out[e.path] = e.stat()
                except OSError:
                    continue
    except OSError:
        return out
    return out


@dataclass
class Arrivals(InputPartition):
    rows: list


class InboxReader(DataSourceStreamReader):
    def __init__(self, folder: str, log: str, settle: float):
        self.folder, self.log, self.settle = folder, OffsetLog(log), settle

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        known, now = self.log.known(), time.time()
        found = {p: st for p, st in _files(self.folder).items() if _arrival(p, st) not in known}
        if any(now - st.st_mtime < self.settle for st in found.values()):
            time.sleep(self.settle)
            again = _files(self.folder)
            found = {p: st for p, st in found.items() if p in again and _arrival(p, again[p]) == _arrival(p, st)}
        if found:
            listed = int(time.time() * 1000)
            self.log.append([[_arrival(p, st), p.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), st.st_size, st.st_mtime_ns, listed,
                              None if os.access(p, os.R_OK) else "unreadable"]
                             for p, st in sorted(found.items(), key=lambda x: (x[1].st_mtime_ns, x[0]))])
        return {"n": self.log.last()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = self.log.rows(start["n"], end["n"])
        return [Arrivals(rows[i:i + ROWS]) for i in range(0, len(rows), ROWS)] or [Arrivals([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*partition.rows, strict=True)) or [()] * len(FIELDS)
        columns[4] = [t * 1000 for t in columns[4]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    def commit(self, end: dict) -> None:
        self.log.commit(end["n"], {_arrival(p, st) for p, st in _files(self.folder).items()})


class InboxSource(DataSource):
    """``spark.readStream.format("briefloom_inbox")`` with options ``folder``, ``log`` and ``settle`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> InboxReader:
        return InboxReader(self.options["folder"], self.options["log"], float(self.options.get("settle", SETTLE_SECONDS)))


def read_inbox(spark: SparkSession, inbox_dir: str, log_dir: str, settle: float = SETTLE_SECONDS) -> DataFrame:
    """S5 + T1: the arrivals of a mounted folder (top level only), as a stream of ``SCHEMA``.

    ``log_dir``, a mounted folder too, holds the offset log; it belongs to the
    checkpoint of the one query that reads this stream.
    """
    spark.dataSource.register(InboxSource)
    return (spark.readStream.format(FORMAT).option("folder", local_path(inbox_dir).rstrip("/"))
            .option("log", local_path(log_dir)).option("settle", settle).load())
