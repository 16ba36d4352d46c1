"""Incremental corpus ingest: change detection (J1), counters (A2), the next
document snapshot (D2) and the per-project ingest session (P19, P20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.functions import formats as T
from briefloom.functions.formats import render
from briefloom.operators.manifest import document_key
from briefloom.schemas import SESSION_FILE_INGEST, SESSION_FOLDER_INGEST

KEY = ["project_id", "relative_path"]


def _one_per_key(scanned: DataFrame) -> DataFrame:
    """Two roots can map two files to one (project, relative path); keep the
    smallest absolute path.  A hash aggregate on the join key: its exchange is
    reused by the join below, so this costs no extra shuffle."""
    cols = [c for c in scanned.columns if c not in KEY]
    return (scanned.groupBy(*KEY)
            .agg(F.min_by(F.struct(*cols), F.col("path")).alias("r"))
            .select(*KEY, "r.*"))


def diff_documents(scanned: DataFrame, previous: DataFrame, include_missing: bool = False,
                   dedupe_previous: bool = False) -> DataFrame:
    """Classify each scanned file against the previous document table.

    ``scanned``: output of ``scan_manifest`` (project_id, path, relative_path,
    kind, hash, size, mtime).  ``previous``: ``DOCUMENTS`` rows.
    status: ``new`` (no previous row), ``updated`` (hash differs), ``skipped``
    (same hash), ``error`` (no hash: the file could not be read) and, with
    ``include_missing``, ``missing`` (previous row whose file was not scanned).  A sort-merge (or AQE broadcast) equi-join on
    (project_id, relative_path); AQE splits a skewed project.
    Snapshots written by ``next_document_snapshot`` hold one row per key; for
    a previous table that may not (the key is not enforced unique), pass
    ``dedupe_previous`` to keep its oldest row per key (same partitioning as
    the join, so no extra shuffle).
    """
    cur = _one_per_key(scanned.select(*KEY, *[c for c in ("root",) if c in scanned.columns], "path", "kind", "hash", "size", "mtime"))
    if dedupe_previous:
        rest = [c for c in previous.columns if c not in KEY]
        previous = (previous.groupBy(*KEY)
                    .agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("_p"))
                    .select(*KEY, *[F.col(f"_p.{c}").alias(c) for c in rest]))
    prev = previous.select(*KEY, *[F.col(c).alias(f"prev_{c}") for c in previous.columns if c not in KEY])
    how = "full" if include_missing else "left"
    j = cur.join(prev, KEY, how)
    status = (F.when(F.col("path").isNull(), "missing")
              .when(F.col("hash").isNull(), "error")
              .when(F.col("prev_id").isNull(), "new")
              .when(F.col("prev_hash") == F.col("hash"), "skipped")
              .otherwise("updated"))
    return j.withColumn("status", status).withColumn(
        "id", F.coalesce(F.col("prev_id"), document_key("project_id", "relative_path")))


def ingest_counters(diff: DataFrame, *by: str) -> DataFrame:
    """Per project (and ``by``, such as ``root``): new / updated / skipped / errors."""
    s = F.col("status")
    return diff.groupBy("project_id", *by).agg(
        F.count_if(s == "new").alias("new"),
        F.count_if(s == "updated").alias("updated"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s == "error").alias("errors"),
    )


def next_document_snapshot(diff: DataFrame, ingested_at, summaries: DataFrame | None = None) -> DataFrame:
    """The document table after the ingest (schema ``DOCUMENTS``).

    ``diff`` must come from ``diff_documents(..., include_missing=True)`` so
    it already carries every previous row: one full outer join builds the
    whole next snapshot.  Changed rows keep their id and created_at and --
    unlike the reference, which blanks them -- their summary and raw_stored;
    new rows get a deterministic id; skipped, missing and unreadable rows are
    kept as they were.  ``summaries`` (project_id, relative_path, summary; one
    row per document) are what an extraction made of the documents: a non-empty
    one replaces the summary.  Callers write the result as a new snapshot.
    """
    if summaries is None:
        diff = diff.withColumn("_new_summary", F.lit(None).cast("string"))
    else:
        diff = diff.join(summaries.select(*KEY, F.col("summary").alias("_new_summary")), KEY, "left")
    diff = diff.where((F.col("status") != "error") | F.col("prev_id").isNotNull())
    changed = F.col("status").isin("new", "updated")

    def pick(cur, prev):
        return F.when(changed, cur).otherwise(F.col(prev))

    return diff.select(
        "id", "project_id",
        pick(F.col("path"), "prev_path").alias("path"),
        "relative_path",
        pick(F.col("kind"), "prev_kind").alias("kind"),
        pick(F.col("hash"), "prev_hash").alias("hash"),
        pick(F.col("size"), "prev_size").alias("size"),
        pick(F.col("mtime"), "prev_modified_at").alias("modified_at"),
        F.coalesce(F.nullif("_new_summary", F.lit("")), "prev_summary", F.lit("")).alias("summary"),
        F.coalesce("prev_raw_stored", F.lit(False)).alias("raw_stored"),
        F.coalesce("prev_created_at", F.lit(ingested_at).cast("timestamp_ntz")).alias("created_at"),
    )


def ingest_sessions(counters: DataFrame, roots: DataFrame) -> DataFrame:
    """P19 + P20: one session row per ingested path and run.

    ``counters``: ``ingest_counters(diff, "root")``.  ``roots``: (project_id,
    root) -- the paths the user ingested; one without files counts zeros.
    """
    j = roots.join(counters, ["project_id", "root"], "left").fillna(0, ["new", "updated", "skipped"])
    n = F.col("new") + F.col("updated")
    return j.select(
        "project_id",
        F.when(n == 1, SESSION_FILE_INGEST).otherwise(SESSION_FOLDER_INGEST).alias("type"),
        render(T.INGEST_SUMMARY, path=F.col("root"), new=F.col("new").cast("string"),
               updated=F.col("updated").cast("string"), skipped=F.col("skipped").cast("string")).alias("summary"),
        F.lit("").alias("next_action"),
    )
