"""Composite jobs (C1-C8): what a user runs, end to end, with durable output.

Each job reads DataFrames, computes with the operators and writes Parquet
under ``out_dir/<table>/run=<run_id>``.  Writes overwrite their own run
folder, so re-running a run (after a driver or executor loss) replaces its
output instead of duplicating it, and every id is derived from keys, so the
rows are identical.  An intermediate used by several outputs is written once
to the shared checkpoint folder and read back, which cuts the lineage: a lost
executor costs a re-read, not a recompute of the whole chain.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import formats as T
from briefloom.functions import levels as L
from briefloom.operators import context as C
from briefloom.operators import diff as D
from briefloom.operators import extraction as X
from briefloom.operators import render as R
from briefloom.operators.manifest import incremental_scan, scan_manifest
from briefloom.operators.sessions import session_rows
from briefloom.session import shared_dir
from briefloom.sources.hooks import hook_texts
from briefloom.sources.tables import BUCKETS, project_bucket


def _write(df: DataFrame, out_dir: str, table: str, run_id: str) -> str:
    path = f"{out_dir.rstrip('/')}/{table}/run={run_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def _materialize(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)


def write_documents_table(df: DataFrame, name: str, buckets: int) -> str:
    """Write a document snapshot as a catalog table bucketed (and sorted) on
    the diff key, so the next ingest joins against it without shuffling it:
    only the new scan moves.  Each run writes its own table (a job cannot
    overwrite the table it reads)."""
    (df.write.mode("overwrite").bucketBy(buckets, *D.KEY).sortBy(*D.KEY).saveAsTable(name))
    return name


def corpus_ingest(spark: SparkSession, files: DataFrame, previous: DataFrame, roots: DataFrame,
                  out_dir: str, run_id: str, ingested_at: str,
                  max_size_bytes: int | None = None, documents_table: str | None = None,
                  buckets: int = 0, summaries: DataFrame | None = None) -> dict[str, str]:
    """Scan -> diff -> next document snapshot, counters, ingest sessions.

    ``files``: manifest (project_id, root, path, size, mtime, hash[, is_symlink]).
    ``previous``: the current document snapshot (``spark.table(...)`` of a
    bucketed snapshot keeps its side of the join in place).
    ``roots``: (project_id, root).  ``summaries``: (project_id, relative_path,
    summary) of extracted documents.  With ``documents_table`` and ``buckets``
    the next snapshot is written as the bucketed catalog table
    ``<documents_table>_<run_id>`` (returned under "documents_table").
    """
    kw = {} if max_size_bytes is None else {"max_size_bytes": max_size_bytes}
    diff = _materialize(spark, D.diff_documents(scan_manifest(files, **kw), previous, include_missing=True),
                        f"ingest-diff-{run_id}")
    present = diff.where("status != 'missing'")
    counters = D.ingest_counters(present)
    snapshot = D.next_document_snapshot(diff, ingested_at, summaries)
    out = {
        "documents": _write(snapshot, out_dir, "documents", run_id),
        "ingest_counters": _write(counters, out_dir, "ingest_counters", run_id),
        "session_entries": _write(
            session_rows(D.ingest_sessions(D.ingest_counters(present, "root"), roots), run_id, ingested_at),
            out_dir, "session_entries", run_id),
    }
    if documents_table and buckets > 0:
        snap = spark.read.parquet(out["documents"])
        out["documents_table"] = write_documents_table(snap, f"{documents_table}_{run_id}", buckets)
    return out


def incremental_export(spark: SparkSession, files: DataFrame, marks_dir: str, out_dir: str, run_id: str,
                       first_marks: DataFrame | None = None, batch: int = 5) -> dict[str, str]:
    """The files (folder, path, mtime) behind each folder's mark, and the marks they leave.

    Marks are an append log, ``marks_dir/run=<run_id>``; runs are named in
    their order (names sort).  A run reads the log of the runs before it and
    publishes its own marks only when its output is written, so a run that
    broke off, or is run again, takes the same files and none is lost.  The
    marks of a folder are the greatest of the log: a mark never goes back.
    ``first_marks`` (folder, hwm) stand before the first run.
    """
    schema = "folder string, hwm timestamp_ntz, hwm_path string"
    log = spark.createDataFrame([], schema)
    try:
        log = (spark.read.schema(f"{schema}, run string").option("basePath", marks_dir).parquet(marks_dir)
               .where(F.col("run") < run_id).select("folder", "hwm", "hwm_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if first_marks is not None:
        log = log.unionByName(first_marks.select("folder", "hwm", F.lit(None).cast("string").alias("hwm_path")))
    at = F.struct("hwm", "hwm_path")
    marks = (log.groupBy("folder").agg(F.max_by(at, F.struct("hwm", F.col("hwm_path").isNull(), "hwm_path")).alias("m"))
             .select("folder", "m.hwm", "m.hwm_path"))
    taken, new = incremental_scan(files, marks, batch=batch)
    out = _write(taken, out_dir, "exported_files", run_id)
    # From what was written: the marks cannot be of other files.
    last = (spark.read.schema(taken.schema).parquet(out).groupBy("folder").agg(F.max(F.struct("mtime", "path")).alias("m"))
            .select("folder", F.col("m.mtime").alias("hwm"), F.col("m.path").alias("hwm_path")))
    last.write.mode("overwrite").parquet(f"{marks_dir.rstrip('/')}/run={run_id}")
    return {"exported_files": out, "marks": f"{marks_dir.rstrip('/')}/run={run_id}"}


def append_rows(rows: DataFrame, table_dir: str, run_id: str, buckets: int = BUCKETS) -> str:
    """Add a run's rows to a table in project buckets (``table_dir/bucket=<n>/run=<run_id>``).

    A run that is made again replaces its own parts and no others.  A project
    with most of the rows is one bucket in several files: the rows are
    rebalanced, not dealt by bucket alone.
    """
    (rows.withColumn("bucket", project_bucket("project_id", buckets)).withColumn("run", F.lit(run_id)).hint("rebalance", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(table_dir))
    return table_dir


def output_ingest(spark: SparkSession, outputs: DataFrame, responses: DataFrame, out_dir: str,
                  run_id: str, reject_empty: bool = False) -> dict[str, str]:
    """C2 pass 2: outputs filled from their extraction answers, plus sessions."""
    normalized = _materialize(spark, X.normalize_outputs(outputs, responses, reject_empty=reject_empty),
                              f"outputs-{run_id}")
    return {
        "coding_outputs": _write(normalized, out_dir, "coding_outputs", run_id),
        "session_entries": _write(X.sessions_from_outputs(normalized), out_dir, "session_entries", run_id),
    }


def text_ingest(spark: SparkSession, texts: DataFrame, out_dir: str, run_id: str, ingested_at: str,
                system_prompt: str = "", model: str = "default") -> dict[str, str]:
    """C2 passes 0 and 1, for explicit paths, hooks and inbox alike: texts
    (project_id, source, raw_text) become outputs, their extraction requests
    and their sessions.  ``output_ingest`` takes the answers."""
    outputs = _materialize(spark, X.outputs_from_texts(texts, run_id, ingested_at), f"texts-{run_id}")
    return {
        "coding_outputs": _write(outputs, out_dir, "coding_outputs", run_id),
        "llm_requests": _write(X.extraction_requests(outputs, system_prompt, model), out_dir, "llm_requests", run_id),
        "session_entries": _write(session_rows(X.sessions_from_outputs(outputs), run_id, ingested_at), out_dir,
                                  "session_entries", run_id),
    }


def hook_ingest(spark: SparkSession, payloads: DataFrame, transcripts: DataFrame, projects: DataFrame,
                settings: DataFrame, out_dir: str, run_id: str, ingested_at: str) -> dict[str, str]:
    """S6 into C2: the transcripts of hook payloads, stored as outputs."""
    return text_ingest(spark, hook_texts(payloads, transcripts, projects, settings), out_dir, run_id, ingested_at)


def brief_requests(spark: SparkSession, requests: DataFrame, projects: DataFrame, outputs: DataFrame,
                   sessions: DataFrame, documents: DataFrame, out_dir: str, run_id: str,
                   system_prompt: str = "", default_model: str = "default") -> dict[str, str]:
    """C4 + C5: model requests for brief requests.

    ``requests``: (request_id, project_id, goal, level, compact_only, full,
    model_override).  Requests with an unknown level or project are written
    to ``brief_rejects`` (the reference refuses them).
    """
    req = L.requested_level("level", "compact_only", "full")
    tagged = requests.withColumn("_req", req)
    valid = (tagged.where(L.level_is_valid("_req"))
             .withColumn("level", L.normalize_level("_req"))
             .withColumn("doc_limit", L.max_docs("level")).drop("_req"))
    rejects = tagged.where(~L.level_is_valid("_req")).select(
        "request_id", "project_id", F.col("_req").alias("level"),
        F.format_string(T.UNKNOWN_LEVEL, F.col("_req")).alias("error"))
    homeless = valid.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_anti")
    rejects = rejects.unionByName(homeless.select("request_id", "project_id", "level", F.lit(T.UNKNOWN_PROJECT).alias("error")))
    bundles = C.context_bundles(projects, outputs, sessions, documents,
                                L.MAX_CONTEXT_OUTPUTS, L.MAX_CONTEXT_SESSIONS, 0)
    ranked = C.rank_documents(valid, documents)
    out = R.brief_requests(valid, bundles, ranked, system_prompt=system_prompt, default_model=default_model)
    return {
        "llm_requests": _write(out, out_dir, "llm_requests", run_id),
        "brief_rejects": _write(rejects, out_dir, "brief_rejects", run_id),
    }


def plan_ingest(spark: SparkSession, responses: DataFrame, out_dir: str, run_id: str,
                planned_at: str) -> dict[str, str]:
    """Parse brief answers (with fallbacks) and record two sessions each.

    ``responses``: (request_id, project_id, request_goal, content, error).
    """
    plans = _materialize(spark, X.parse_plans(responses), f"plans-{run_id}")
    return {
        "plan_results": _write(plans, out_dir, "plan_results", run_id),
        "session_entries": _write(session_rows(X.plan_sessions(plans), run_id, planned_at), out_dir, "session_entries", run_id),
    }


def handoff_export(spark: SparkSession, projects: DataFrame, outputs: DataFrame, sessions: DataFrame,
                   documents: DataFrame, out_dir: str, run_id: str, generated: str,
                   full: bool = False, compact: bool = False) -> dict[str, str]:
    """One handoff document per project plus the export session rows."""
    bundles = C.context_bundles(projects, outputs, sessions, documents, *L.export_limits(full, compact))
    return {
        "handoffs": _write(R.handoff_documents(bundles, generated, compact=compact), out_dir, "handoffs", run_id),
        "session_entries": _write(session_rows(R.export_sessions(projects), run_id, generated), out_dir, "session_entries", run_id),
    }


def project_status(spark: SparkSession, projects: DataFrame, documents: DataFrame, sessions: DataFrame,
                   out_dir: str, run_id: str) -> dict[str, str]:
    """Document count and three newest sessions per project."""
    return {"project_status": _write(C.project_status(projects, documents, sessions), out_dir,
                                     "project_status", run_id)}
