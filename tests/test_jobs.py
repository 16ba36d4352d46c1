"""Composite jobs write durable, idempotent output."""

import tempfile

from pyspark.sql import functions as F

from briefloom.plans import jobs
from briefloom.sources import fixtures as fx
from conftest import SF_SMALL


def _rows(spark, path, cols):
    return sorted(tuple(r) for r in spark.read.parquet(path).select(*cols).collect())


def test_corpus_ingest_rerun_is_idempotent_and_converges(spark):
    out = tempfile.mkdtemp(prefix="briefloom-test-")
    files = fx.current_scan(spark, SF_SMALL)
    prev = fx.previous_documents(spark, SF_SMALL)
    roots = files.select("project_id", "root").distinct()
    a = jobs.corpus_ingest(spark, files, prev, roots, out, "r1", "2024-06-01 00:00:00")
    first = _rows(spark, a["documents"], ["id", "hash", "summary"])
    b = jobs.corpus_ingest(spark, files, prev, roots, out, "r1", "2024-06-01 00:00:00")
    assert _rows(spark, b["documents"], ["id", "hash", "summary"]) == first
    # a second run on the new snapshot changes nothing
    snap = spark.read.parquet(a["documents"])
    c = jobs.corpus_ingest(spark, files, snap, roots, out, "r2", "2024-06-02 00:00:00")
    counts = spark.read.parquet(c["ingest_counters"]).agg(F.sum("new"), F.sum("updated")).first()
    assert tuple(counts) == (0, 0)
    assert _rows(spark, c["documents"], ["id", "hash", "summary"]) == first


def test_brief_requests_job_rejects_unknown_levels(spark):
    out = tempfile.mkdtemp(prefix="briefloom-test-")
    paths = jobs.brief_requests(spark, fx.plan_requests_input(spark, SF_SMALL), fx.context_projects(spark, SF_SMALL),
                                fx.coding_outputs(spark, SF_SMALL), fx.session_entries(spark, SF_SMALL),
                                fx.context_documents(spark, SF_SMALL), out, "r1", system_prompt="sys")
    req = spark.read.parquet(paths["llm_requests"])
    rej = spark.read.parquet(paths["brief_rejects"])
    total = fx.plan_requests_input(spark, SF_SMALL).count()
    assert req.count() + rej.count() == total and rej.count() > 0
    assert rej.first().error.startswith('unknown detail level "bogus"')
    assert req.where(F.col("messages")[0]["content"] != "sys").count() == 0


def test_a_handoff_reads_what_the_jobs_wrote(spark):
    """Ingest, outputs, plans and handoff over the engine's own tables."""
    from briefloom.schemas import DOCUMENTS, SESSION_ENTRIES
    out = tempfile.mkdtemp(prefix="briefloom-test-")
    files = fx.current_scan(spark, SF_SMALL)
    none = fx.previous_documents(spark, SF_SMALL).limit(0)
    projects = fx.context_projects(spark, SF_SMALL)
    a = jobs.corpus_ingest(spark, files, none, fx.ingest_roots(spark, SF_SMALL), out, "r1", "2024-06-01 00:00:00",
                           summaries=fx.document_summaries(spark, SF_SMALL))
    b = jobs.output_ingest(spark, fx.coding_outputs(spark, SF_SMALL), fx.extraction_responses(spark, SF_SMALL), out, "r2")
    c = jobs.plan_ingest(spark, fx.plan_responses(spark, SF_SMALL), out, "r3", "2024-06-01 11:00:00")
    d = jobs.handoff_export(spark, projects, spark.read.parquet(b["coding_outputs"]), spark.read.parquet(c["session_entries"]),
                            spark.read.parquet(a["documents"]), out, "r4", "2024-06-01 12:00")
    names = lambda path, schema: [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).select(
        *schema.fieldNames()).schema] == [(f.name, f.dataType.simpleString()) for f in schema]
    assert names(a["documents"], DOCUMENTS)
    for run in (a, b, c, d):
        assert names(run["session_entries"], SESSION_ENTRIES)
        s = spark.read.parquet(run["session_entries"])
        assert s.where(F.col("id").isNull() | F.col("created_at").isNull()).count() == 0 and s.count() == s.select("id").distinct().count()
    h = spark.read.parquet(d["handoffs"])
    assert h.count() == projects.count() and h.where(F.size("relevant_files") > 0).count() > 0
    e = jobs.brief_requests(spark, fx.plan_requests_input(spark, SF_SMALL), projects, spark.read.parquet(b["coding_outputs"]),
                            spark.read.parquet(c["session_entries"]), spark.read.parquet(a["documents"]), out, "r5")
    assert spark.read.parquet(e["llm_requests"]).where(F.col("messages")[1]["content"].isNull()).count() == 0
    assert spark.read.parquet(e["brief_rejects"]).where(F.col("error") == "project not found").count() > 0


def test_hooks_become_outputs_requests_and_sessions(spark):
    out = tempfile.mkdtemp(prefix="briefloom-test-")
    projects = fx.context_projects(spark, SF_SMALL).limit(1)
    root = projects.first().root_path
    payloads = spark.createDataFrame([
        (f'{{"session_id": "a", "transcript_path": "/t/1", "cwd": "{root}/x"}}',), ('{"transcript_path": "/t/2"}',),
        ('{"transcript_path": "/t/3", "cwd": null}',), ('{"transcript_path": "", "cwd": "/"}',), ("broken",),
        ('{"transcript_path": "/t/4", "cwd": "\\ud83d"}',)], "payload string")
    transcripts = spark.createDataFrame([(f"/t/{i}", f"text {i}") for i in range(1, 5)], "transcript_path string, transcript string")
    active = spark.createDataFrame([("active_project_id", projects.first().id)], "key string, value string")
    done = jobs.hook_ingest(spark, payloads, transcripts, projects, active, out, "r1", "2024-06-01 00:00:00")
    assert _rows(spark, done["coding_outputs"], ["raw_text"]) == [(f"text {i}",) for i in range(1, 5)]
    assert spark.read.parquet(done["llm_requests"]).count() == spark.read.parquet(done["session_entries"]).count() == 4
    again = jobs.hook_ingest(spark, payloads, transcripts, projects, active, out, "r1", "2024-06-01 00:00:00")
    assert spark.read.parquet(again["coding_outputs"]).count() == 4


def test_other_jobs_write_their_tables(spark):
    out = tempfile.mkdtemp(prefix="briefloom-test-")
    projects, outputs = fx.context_projects(spark, SF_SMALL), fx.coding_outputs(spark, SF_SMALL)
    sessions, docs = fx.session_entries(spark, SF_SMALL), fx.context_documents(spark, SF_SMALL)
    a = jobs.output_ingest(spark, outputs, fx.extraction_responses(spark, SF_SMALL), out, "r1")
    assert spark.read.parquet(a["coding_outputs"]).count() == outputs.count()
    assert spark.read.parquet(a["session_entries"]).count() == outputs.count()
    b = jobs.plan_ingest(spark, fx.plan_responses(spark, SF_SMALL), out, "r1", "2024-06-01 12:00:00")
    n_plans = spark.read.parquet(b["plan_results"]).count()
    assert spark.read.parquet(b["session_entries"]).count() == 2 * n_plans
    c = jobs.handoff_export(spark, projects, outputs, sessions, docs, out, "r1", "2024-06-01 12:00")
    h = spark.read.parquet(c["handoffs"])
    assert h.count() == projects.count()
    assert h.where(~F.col("document").startswith("# Handoff: ")).count() == 0
    assert spark.read.parquet(c["session_entries"]).where(F.col("summary").startswith("export for project '")).count() \
        == projects.count()
    d = jobs.project_status(spark, projects, docs, sessions, out, "r1")
    assert spark.read.parquet(d["project_status"]).count() == projects.count()


def test_bucketed_snapshot_keeps_previous_side_in_place(spark):
    import re

    from briefloom.operators import diff as D
    from briefloom.operators.manifest import scan_manifest
    out = tempfile.mkdtemp(prefix="briefloom-test-")
    files = fx.current_scan(spark, SF_SMALL)
    roots = files.select("project_id", "root").distinct()
    a = jobs.corpus_ingest(spark, files, fx.previous_documents(spark, SF_SMALL), roots, out, "b1",
                           "2024-06-01 00:00:00", documents_table="documents", buckets=8)
    prev = spark.table(a["documents_table"])
    diff = D.diff_documents(scan_manifest(files), prev, include_missing=True)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(project_id", plan)) == 1
    plain = D.diff_documents(scan_manifest(files), spark.read.parquet(a["documents"]), include_missing=True)
    cols = ["project_id", "relative_path", "status", "id"]
    assert sorted(diff.select(*cols).collect()) == sorted(plain.select(*cols).collect())
    assert {r.status for r in diff.select("status").distinct().collect()} <= {"skipped", "missing", "error"}
