"""Context bundles from bounded summaries (J7, C4): a brief does not scan the history.

Each run keeps its newest N rows of every project; the newest N of all runs
are among them, so lists of runs merge into a list of the same kind.  Runs are
named in the order they were made (their names sort).  ``compact`` folds all
runs so far into one; readers begin at the last such run.  Documents are
snapshots: their last run alone counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import levels as L
from briefloom.operators import context as C

OUTPUT_COLS = ["id", "project_id", "goal", "next_actions", "blockers", "decisions", "files", "created_at"]
SESSION_COLS = ["id", "project_id", "type", "summary", "next_action", "created_at"]
DOCUMENT_COLS = ["id", "project_id", "relative_path", "summary", "kind", "modified_at"]
KEPT = {  # columns, time, rows a project, whether runs add up
    "outputs": (OUTPUT_COLS, "created_at", max(L.MAX_CONTEXT_OUTPUTS, 10), True),
    "sessions": (SESSION_COLS, "created_at", max(L.MAX_CONTEXT_SESSIONS, 10), True),
    "documents": (DOCUMENT_COLS, "modified_at", 20, False),
}


def _newest(rows: DataFrame, kind: str) -> DataFrame:
    cols, time, n, _ = KEPT[kind]
    if kind == "documents":
        rows = rows.where(F.col("summary") != "")
    return C.newest_per_project(rows.select(*cols), n, time).drop("recency_rank")


def write_summary(rows: DataFrame, kind: str, summary_dir: str, run_id: str, whole: bool = False) -> str:
    """The newest rows of one run (``whole``: of all runs up to it); a re-run overwrites its own."""
    path = f"{summary_dir.rstrip('/')}/{kind}/whole={str(whole).lower()}/run={run_id}"
    _newest(rows, kind).write.mode("overwrite").parquet(path)
    return path


def read_summary(spark: SparkSession, kind: str, summary_dir: str) -> DataFrame:
    """The rows that stand for all runs."""
    cols, _, _, adds_up = KEPT[kind]
    rows = (spark.read.option("basePath", f"{summary_dir.rstrip('/')}/{kind}").parquet(f"{summary_dir.rstrip('/')}/{kind}")
            .withColumn("run", F.col("run").cast("string")).withColumn("whole", F.col("whole").cast("boolean")))
    runs = rows.select("run", "whole").distinct()
    last = (runs.where("whole") if adds_up else runs).agg(F.max("run").alias("run")).first()["run"]
    if not adds_up:
        return rows.where(F.col("run") == F.lit(last)).select(*cols)
    if last is not None:
        rows = rows.where((F.col("run") > last) | ((F.col("run") == last) & F.col("whole")))
    return rows.select(*cols)


def compact(spark: SparkSession, kind: str, summary_dir: str, run_id: str) -> str:
    """Fold the runs so far into one; ``run_id`` is the last of them."""
    return write_summary(read_summary(spark, kind, summary_dir), kind, summary_dir, run_id, whole=True)


def context_from_summaries(spark: SparkSession, projects: DataFrame, summary_dir: str,
                           max_outputs: int, max_sessions: int, max_docs: int) -> DataFrame:
    """``context_bundles`` over the summaries; the limits may not exceed what a run keeps."""
    for kind, n in (("outputs", max_outputs), ("sessions", max_sessions), ("documents", max_docs)):
        if n > KEPT[kind][2]:
            raise ValueError(f"a summary keeps {KEPT[kind][2]} {kind} a project")
    return C.context_bundles(projects, *[read_summary(spark, k, summary_dir) for k in KEPT], max_outputs, max_sessions, max_docs)
