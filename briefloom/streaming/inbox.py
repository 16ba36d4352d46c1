"""Arrival streams: filters, dedupe and ingest of (path, content) rows from any source.

The folder itself is read by ``sources.inbox`` and ingested by
``streaming.watch``.  These functions serve streams that carry contents:
``dropDuplicates`` on the path keeps the seen-set in the checkpointed state
store, and ``foreachBatch`` writes each micro-batch's outputs and sessions to
a per-batch folder, so a replayed batch overwrites itself instead of appending
twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.functions import paths as P
from briefloom.operators.extraction import sessions_from_outputs

# Fixed values.
PROCESSED_DIR = "processed"

def archive_name(path, batch_id) -> F.Column:
    """``<stem>-<batch id><ext>`` -- the batch id replaces the clock, so
    a replayed batch archives under the same name."""
    path = F.col(path) if isinstance(path, str) else path
    base = P.base_name(path)
    ext = P.extension(path)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return F.concat(stem, F.lit("-"), F.lit(batch_id).cast("string"), ext)


def accepted(files: DataFrame, inbox_dir: str | None = None) -> DataFrame:
    """F6 + F7 as row filters (for sources that cannot filter by glob)."""
    cond = P.inbox_accepts("path")
    if inbox_dir:
        cond = cond & ~F.col("path").startswith(inbox_dir.rstrip("/") + "/" + PROCESSED_DIR + "/")
    return files.where(cond)


def rejected(files: DataFrame) -> DataFrame:
    """T4: arrivals the inbox skips, with the reason."""
    return (files.where(~P.inbox_accepts("path"))
            .select("arrival_id", "path", F.lit("unsupported_extension").alias("reason")))


def dedupe_paths(files: DataFrame, horizon: str | None = None) -> DataFrame:
    """The first arrival of each path; later re-drops are ignored.

    On a stream the seen paths live in the state store (checkpointed).  Like
    the reference's seen-set, that state grows with every distinct path; with
    ``horizon`` (e.g. ``"7 days"``) a re-drop is only recognised within that
    event-time window of ``arrived_at`` and older state is evicted.
    """
    if horizon:
        # watermarks need TIMESTAMP (not TIMESTAMP_NTZ): use a cast copy
        return (files.withColumn("_wm", F.col("arrived_at").cast("timestamp"))
                .withWatermark("_wm", horizon).dropDuplicatesWithinWatermark(["path"]).drop("_wm"))
    return files.dropDuplicates(["path"])


def outputs_from_files(files: DataFrame, ingested_at: str) -> DataFrame:
    """T3 / C2 with the no-op extractor: one output row per inbox file."""
    empty = F.array().cast("array<string>")
    return files.select(
        F.sha2(F.concat(F.lit("inbox|"), F.col("path")), 256).alias("id"),
        "project_id",
        F.col("path").alias("source"),
        F.col("content").alias("raw_text"),
        F.lit("").alias("goal"),
        empty.alias("actions"), empty.alias("files"), empty.alias("decisions"),
        empty.alias("blockers"), empty.alias("next_actions"), empty.alias("validation_notes"),
        empty.alias("commit_recommendations"),
        F.lit(ingested_at).cast("timestamp_ntz").alias("created_at"),
    )


def ingest_batch_writer(out_dir: str, ingested_at: str):
    """foreachBatch body: write outputs + sessions of one micro-batch."""
    out_dir = out_dir.rstrip("/")

    def _write(batch: DataFrame, batch_id: int) -> None:
        path = f"{out_dir}/outputs/batch={batch_id}"
        outputs = outputs_from_files(batch, ingested_at)
        outputs.write.mode("overwrite").parquet(path)
        stored = batch.sparkSession.read.schema(outputs.schema).parquet(path)
        sessions_from_outputs(stored).write.mode("overwrite").parquet(f"{out_dir}/sessions/batch={batch_id}")

    return _write


def run_inbox(files: DataFrame, out_dir: str, checkpoint_dir: str, ingested_at: str,
              available_now: bool = True, horizon: str | None = None):
    """Start the inbox ingest on a streaming DataFrame of
    (arrival_id, path, content, project_id[, arrived_at]).  Returns the
    StreamingQuery.  For large seen-sets use the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``) or a ``horizon``."""
    deduped = dedupe_paths(accepted(files), horizon)
    writer = (deduped.writeStream.foreachBatch(ingest_batch_writer(out_dir, ingested_at))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def run_to_table(df: DataFrame, out_dir: str, checkpoint_dir: str):
    """Drain a streaming DataFrame into a Parquet folder (availableNow)."""
    q = (df.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
