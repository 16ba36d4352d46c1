"""The inbox job: arrivals -> one state per path -> texts, outputs, requests, sessions -> archive.

* *State* (``PathState``): each path has one value in the state store (how
  often it arrived, what became of it and why).  Of a path the first arrival is
  taken; later ones are duplicates until the state's timer clears it.  A path
  that failed may be dropped again.  Only names and sizes reach the state's
  exchange: contents are read afterwards, and of files that are taken alone.
* *Batches* (``InboxSink``): a micro-batch writes its decisions, reads its
  files in tasks, stores outputs, extraction requests and sessions under its
  own run, and its dead letters (arrival, path, reason) to ``inbox_rejects``.
  One bad file is a dead letter and stops nothing.
* *Archive*: what a batch will move is written first (``archive_intents``),
  and only when all of its rows are stored; tasks then move the files and write
  what they did (``archived``).  A batch that is run again after a crash begins
  where it stopped: with an intent there is nothing to store, and a file that
  has been moved stays where it is.  A name that was dropped anew meanwhile is
  left for its own batch.  Archived names carry the batch, so a name may be
  archived any number of times.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from briefloom.functions import paths as P
from briefloom.operators.resolve import lookup_projects, resolve_projects
from briefloom.plans import jobs
from briefloom.session import local_path
from briefloom.sources.inbox import read_inbox
from briefloom.streaming.inbox import PROCESSED_DIR, archive_name

TAKEN, DUPLICATE, FAILED = "taken", "duplicate", "failed"
UNSUPPORTED = "unsupported_extension"
SEEN = "seen_before"
DECISION = "arrival_id string, path string, size long, mtime_ns long, listed_at timestamp, decision string, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPLIT_BYTES = 64 << 20
OPENING = 64 << 10
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class PathState(StatefulProcessor):
    """T2 + T4: what becomes of each arrival of a path; ``horizon`` (ms, 0: forever) bounds the memory."""

    def __init__(self, exts: tuple[str, ...], horizon: int = 0):
        self.exts, self.horizon = exts, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("path", "arrivals long, status string, reason string, last_at long")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        arrivals, status, reason, last_at = self.state.get() if self.state.exists() else (0, None, None, 0)
        for r in sorted(rows, key=lambda r: (r.listed_at, r.mtime_ns, r.arrival_id)):
            at = int(r.listed_at.timestamp() * 1000)
            if self.horizon and at > last_at + self.horizon:
                arrivals, status, reason = 0, None, None  # the timer has not come yet
            if os.path.splitext("_" + os.path.basename(r.path))[1] not in self.exts:
                decision, why = FAILED, UNSUPPORTED
            elif status == TAKEN:
                decision, why = DUPLICATE, SEEN
            elif r.error:
                decision, why = FAILED, r.error
            else:
                decision, why = TAKEN, None
            arrivals, last_at = arrivals + 1, at
            if decision != DUPLICATE:
                status, reason = decision, why
            yield Row(arrival_id=r.arrival_id, path=r.path, size=r.size, mtime_ns=r.mtime_ns, listed_at=r.listed_at, decision=decision, reason=why)
        self.state.update((arrivals, status, reason, last_at))
        if self.horizon:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last_at + self.horizon)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def decide(arrivals: DataFrame, horizon_seconds: int = 0, exts: tuple[str, ...] = tuple(P.INBOX_EXTS)) -> DataFrame:
    """A decision for each arrival (``DECISION``)."""
    processor = PathState(exts, horizon_seconds * 1000)
    timed = arrivals.withWatermark("listed_at", "0 seconds") if horizon_seconds else arrivals
    return timed.groupBy("path").transformWithState(
        processor, outputStructType=DECISION, outputMode="Append", timeMode="EventTime" if horizon_seconds else "None")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents, a file at a time; bytes that are no UTF-8 become U+FFFD."""
    for b in batches:
        for arrival, path in zip(b.column("arrival_id").to_pylist(), b.column("path").to_pylist(), strict=True):
            text, error = None, None
            try:
                with open(path, "rb") as f:
                    text = f.read().decode("utf-8", "replace")
            except OSError as e:
                error = f"read: {e.strerror}"
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (arrival, path, text, error)],
                                             ["arrival_id", "path", "raw_text", "error"])


def _move(src: str, dst: str, size: int, mtime_ns: int) -> str | None:
    """None if the file is at ``dst`` now, else why it is not."""
    try:
        st = os.stat(src)
    except FileNotFoundError:
        return None if os.path.exists(dst) else "gone"
    except OSError as e:
        return e.strerror
    if (st.st_size, st.st_mtime_ns) != (size, mtime_ns):
        return None if os.path.exists(dst) else "changed"
    try:
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        os.rename(src, dst)
    except OSError as e:
        return e.strerror
    return None


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        why = [_move(r["src"], r["dst"], r["size"], r["mtime_ns"]) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array([w is None for w in why]), pa.array(why, pa.string())],
                                         ["src", "dst", "moved", "reason"])


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


class InboxSink:
    """The ``foreachBatch`` body: stores a batch, then archives its files."""

    def __init__(self, inbox_dir: str, out_dir: str, project_id: str, ingested_at: str, archive_dir: str | None = None,
                 system_prompt: str = "", model: str = "default"):
        self.out_dir, self.project_id, self.ingested_at = out_dir.rstrip("/"), project_id, ingested_at
        self.archive_dir = local_path(archive_dir or f"{inbox_dir.rstrip('/')}/{PROCESSED_DIR}").rstrip("/")
        self.system_prompt, self.model = system_prompt, model

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.out_dir}/{table}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if _written(batch.sparkSession, self._path("archive_intents", batch_id)):
            batch.write.format("noop").mode("overwrite").save()  # the states of a batch that is run again
        else:
            self.store(batch, batch_id)
        self.archive(batch.sparkSession, batch_id)

    def store(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(self._path("inbox_decisions", batch_id))
        decided = spark.read.schema(DECISION).parquet(self._path("inbox_decisions", batch_id))
        taken = decided.where(F.col("decision") == TAKEN)
        cost = taken.agg(F.sum(F.col("size") + OPENING)).first()[0] or 0
        # The batch's files are read once: what is stored of them comes from this table.
        texts = jobs._materialize(spark, taken.select("arrival_id", "path").repartition(max(1, -(-cost // SPLIT_BYTES)), "path")
                                  .mapInArrow(_read, "arrival_id string, path string, raw_text string, error string"), f"inbox-{batch_id}")
        good = texts.where("error is null")
        jobs.text_ingest(spark, good.select(F.lit(self.project_id).alias("project_id"), F.col("path").alias("source"), "raw_text"),
                         self.out_dir, f"inbox-{batch_id}", self.ingested_at, self.system_prompt, self.model)
        (decided.where(F.col("decision") != TAKEN).select("arrival_id", "path", "reason")
         .unionByName(texts.where("error is not null").select("arrival_id", "path", F.col("error").alias("reason")))
         .write.mode("overwrite").parquet(self._path("inbox_rejects", batch_id)))
        # Last: with the intents the batch is stored.  Duplicates leave the inbox as well.
        leaving = (decided.where(F.col("decision") == DUPLICATE).select("arrival_id", "path", "size", "mtime_ns")
                   .unionByName(taken.select("arrival_id", "path", "size", "mtime_ns").join(good.select("arrival_id"), "arrival_id", "left_semi")))
        (leaving.select(F.col("path").alias("src"), F.concat(F.lit(self.archive_dir + "/"), archive_name("path", batch_id)).alias("dst"),
                        "size", "mtime_ns").write.mode("overwrite").parquet(self._path("archive_intents", batch_id)))

    def archive(self, spark: SparkSession, batch_id: int) -> None:
        """D8 + T5: the batch's moves, by tasks; those already made are kept."""
        if _written(spark, self._path("archived", batch_id)):
            return
        intents = spark.read.schema("src string, dst string, size long, mtime_ns long").parquet(self._path("archive_intents", batch_id))
        (intents.mapInArrow(_moved, "src string, dst string, moved boolean, reason string")
         .write.mode("overwrite").parquet(self._path("archived", batch_id)))


def inbox_project(projects: DataFrame, settings: DataFrame, cwd: str, key: str = "") -> str:
    """The project that an inbox feeds: by name or id if given, else the folder's, else the active one."""
    spark = projects.sparkSession
    if key:
        found = lookup_projects(spark.createDataFrame([(key,)], "key string"), projects)
    else:
        found = resolve_projects(spark.createDataFrame([(1, cwd)], "cwd_id long, cwd string"), projects, settings, "detect_first")
    row = found.first()
    if row is None or row["project_id"] is None:
        raise ValueError(f"no project {key!r}" if key else f"no project holds {cwd} and none is active")
    return row["project_id"]


def watch_inbox(spark: SparkSession, inbox_dir: str, out_dir: str, checkpoint_dir: str, project_id: str, ingested_at: str,
                available_now: bool = True, horizon_seconds: int = 0, archive_dir: str | None = None,
                sink: type[InboxSink] = InboxSink, **options):
    """Start the inbox job on a mounted folder; returns the StreamingQuery.

    Writes ``coding_outputs``, ``llm_requests`` and ``session_entries`` under
    ``run=inbox-<batch>``, and ``inbox_decisions``, ``inbox_rejects``,
    ``archive_intents`` and ``archived`` under ``batch=<batch>``.  Files are
    archived to ``archive_dir`` (by default ``processed`` in the inbox, which
    must be on the same mount).  ``horizon_seconds``: how long a path is
    remembered; 0 keeps it for good.  With ``available_now`` a start that finds
    an unfinished batch ends with that batch; the next one takes what came since.
    """
    os.makedirs(local_path(inbox_dir), exist_ok=True)
    arrivals = read_inbox(spark, inbox_dir, f"{checkpoint_dir.rstrip('/')}/inbox-log")
    body = sink(local_path(inbox_dir), out_dir, project_id, ingested_at, archive_dir, **options)
    writer = decide(arrivals, horizon_seconds).writeStream.foreachBatch(body).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)  # states by value need it; the query keeps what it began with
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
