"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the test tables through ``briefloom.sources.fixtures`` and
emits scalar columns (lists joined with '|') so results compare directly
with the DuckDB twins in ``briefloom.plans.oracle``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import levels as L
from briefloom.functions import paths as P
from briefloom.functions.text import extract_json_block, tokenize
from briefloom.operators import context as C
from briefloom.operators import diff as D
from briefloom.operators import dml
from briefloom.operators import extraction as X
from briefloom.operators import render as R
from briefloom.operators import resolve as J
from briefloom.operators import summary as S
from briefloom.operators.folder_diff import diff_by_folder
from briefloom.operators.manifest import content_hash, incremental_scan, scan_manifest
from briefloom.operators.sessions import session_rows
from briefloom.plans import jobs
from briefloom.session import local_path, shared_dir
from briefloom.sources import fixtures as fx
from briefloom.sources.tables import read_project, read_table
from briefloom.sources.tree import manifest_from_tree
from briefloom.streaming import inbox as I
from briefloom.streaming import watch as W

SEP = "|"
GENERATED = "2024-06-01 12:00"
INGESTED_AT = "2024-06-01 12:00:00"
STANDARD = L.CONTEXT_LIMITS["standard"]


def _j(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c, SEP)


def _n(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.size(c).cast("bigint")


# ---------------------------------------------------------------- manifest
def q_manifest_scan(spark, sf):
    m = scan_manifest(fx.manifest(spark, sf))
    return m.select("project_id", "path", "relative_path", "kind", "size", "hash")


def q_content_hash(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return content_hash(d).select("doc_id", "hash")


def q_kind_distribution(spark, sf):
    m = fx.manifest(spark, sf)
    return (m.groupBy(P.file_kind("path").alias("kind"))
            .agg(F.count("*").alias("n_files")))


def q_relative_paths(spark, sf):
    m = fx.manifest(spark, sf)
    return m.select("path", P.relative_path("path", "root").alias("relative_path"),
                    P.base_name("path").alias("base_name"), P.extension("path").alias("extension"))


def _hwm_marks(m: DataFrame) -> DataFrame:
    num = F.regexp_extract("project_id", r"(\d+)$", 1).cast("bigint")
    return (m.where(num % 3 != 0).groupBy(F.col("project_id").alias("folder"))
            .agg(F.floor(F.avg("doc_id")).cast("bigint").alias("_mid"))
            .select("folder", F.expr(f"timestampadd(MINUTE, _mid, {fx.EPOCH})").alias("hwm")))


def q_incremental_scan(spark, sf):
    m = fx.manifest(spark, sf)
    files = m.select(F.col("project_id").alias("folder"), "path", "mtime")
    taken, _ = incremental_scan(files, _hwm_marks(m))
    return taken.select("folder", "path", "ord")


def q_incremental_scan_next(spark, sf):
    """The run after ``incremental_scan``, over files of which many share a modification time."""
    m = fx.manifest(spark, sf, fx.CORPUS_DIRS)
    files = m.select(F.col("project_id").alias("folder"), "path",
                     F.expr(f"timestampadd(MINUTE, doc_id div 400, {fx.EPOCH})").alias("mtime"))
    _, marks = incremental_scan(files, _hwm_marks(m).withColumn("hwm", F.expr("TIMESTAMP_NTZ'2023-12-31 00:00:00'")))
    taken, _ = incremental_scan(files, marks)
    return taken.select("folder", "path", "ord")


# ------------------------------------------------------------------- diff
def _diff(spark, sf, include_missing=False):
    scanned = scan_manifest(fx.current_scan(spark, sf))
    return D.diff_documents(scanned, fx.previous_documents(spark, sf), include_missing=include_missing)


def q_ingest_diff(spark, sf):
    return _diff(spark, sf, include_missing=True).select("project_id", "relative_path", "status", "id")


def q_ingest_diff_folders(spark, sf):
    scanned = scan_manifest(fx.current_scan(spark, sf))
    diff = diff_by_folder(scanned, fx.previous_documents(spark, sf), include_missing=True)
    return diff.select("project_id", "relative_path", "status", "id")


def q_incremental_export(spark, sf):
    """The second run of the job over files of which many share a modification time."""
    base = shared_dir(spark, "export-runs")
    m = fx.manifest(spark, sf, fx.CORPUS_DIRS)
    files = m.select(F.col("project_id").alias("folder"), "path",
                     F.expr(f"timestampadd(MINUTE, doc_id div 400, {fx.EPOCH})").alias("mtime"))
    first = _hwm_marks(m).withColumn("hwm", F.expr("TIMESTAMP_NTZ'2023-12-31 00:00:00'"))
    for run in ("1", "2"):
        out = jobs.incremental_export(spark, files, f"{base}/marks", f"{base}/out", run, first)
    return spark.read.parquet(out["exported_files"]).select("folder", "path", "ord")


def q_ingest_summary(spark, sf):
    return D.ingest_counters(_diff(spark, sf))


def q_ingest_sessions(spark, sf):
    return D.ingest_sessions(D.ingest_counters(_diff(spark, sf), "root"), fx.ingest_roots(spark, sf))


def q_session_append(spark, sf):
    ingest = D.ingest_sessions(D.ingest_counters(_diff(spark, sf), "root"), fx.ingest_roots(spark, sf))
    parts = [ingest, R.export_sessions(fx.context_projects(spark, sf)), X.plan_sessions(_plans(spark, sf))]
    rows = [session_rows(p, "batch-1", INGESTED_AT) for p in parts]
    return (rows[0].unionByName(rows[1]).unionByName(rows[2])
            .select("id", "project_id", "type", "summary", _j("related_files").alias("related_files"),
                    _j("open_questions").alias("open_questions"), "next_action", F.col("created_at").cast("string").alias("created_at")))


def q_document_upsert(spark, sf):
    snap = D.next_document_snapshot(_diff(spark, sf, include_missing=True), INGESTED_AT, fx.document_summaries(spark, sf))
    return snap.select("id", "project_id", "relative_path", "kind", "hash", "size", "summary", "raw_stored")


# -------------------------------------------------------------- projects
def _settings(spark, sf):
    return J.latest_settings(fx.settings_log(spark, sf))


def q_settings_latest(spark, sf):
    return _settings(spark, sf).select("key", "value")


def q_project_list(spark, sf):
    return J.list_projects(fx.resolution_projects(spark, sf), _settings(spark, sf)) \
        .select("id", "name", "root_path", "is_active")


def q_resolve_project(spark, sf):
    return J.detect_projects(fx.resolution_cwds(spark, sf), fx.resolution_projects(spark, sf)) \
        .select("cwd_id", "cwd", "project_id")


def q_resolve_project_modes(spark, sf):
    r = J.resolve_projects_all_modes(fx.resolution_cwds(spark, sf), fx.resolution_projects(spark, sf),
                                     _settings(spark, sf))
    return r.select("cwd_id", "mode", "project_id", "resolved_by", "error")


def _lookup_keys(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    root = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    key = (F.when(F.col("page_id") % 3 == 0, F.substring(F.sha2(root, 256), 1, 16))
           .when(F.col("page_id") % 3 == 1, P.default_project_name(root))
           .otherwise(F.concat(F.lit("missing-"), F.col("page_id").cast("string"))))
    return p.select(key.alias("key")).distinct()


def q_project_lookup(spark, sf):
    return J.lookup_projects(_lookup_keys(spark, sf), fx.resolution_projects(spark, sf))


def _register_candidates(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    host_root = F.concat(F.lit("/srv/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    name = (F.when(F.col("page_id") % 17 == 0, F.lit(""))
            .when(F.col("page_id") % 19 == 0, F.concat(F.lit("proj-src"), (F.col("page_id") % 20).cast("string")))
            .otherwise(P.default_project_name(host_root)))
    return p.select(name.alias("name"), host_root.alias("root_path"),
                    F.lit("").alias("summary"),
                    F.expr(f"timestampadd(SECOND, page_id, {fx.EPOCH})").alias("created_at"))


def q_project_register(spark, sf):
    r = dml.register_projects(fx.context_projects(spark, sf), _register_candidates(spark, sf))
    return r.select("id", "name", "root_path", "status", "n_candidates")


def _changes(spark, sf):
    b = read_table(spark, sf, "benchmark").select("item_id", "text")
    return b.select(F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("id"),
                    F.col("text").alias("summary"),
                    F.expr(f"timestampadd(HOUR, item_id, TIMESTAMP_NTZ'2024-03-01 00:00:00')").alias("updated_at"))


def q_project_update(spark, sf):
    projects = fx.context_projects(spark, sf)
    changes = (_changes(spark, sf).withColumn("name", F.concat(F.lit("new-"), F.col("id")))
               .withColumn("active_goals", F.array(F.col("summary"))))
    done = dml.update_projects(projects, changes)
    unknown = dml.unknown_changes(projects, changes)
    none = F.lit(None).cast("string")
    return (done.select("id", "name", "root_path", "summary", _j("active_goals").alias("goals"), "status")
            .unionByName(unknown.select("id", none.alias("name"), none.alias("root_path"), none.alias("summary"),
                                        none.alias("goals"), F.lit("not_found").alias("status"))))


def q_project_use(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    root = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    key = (F.when(F.col("page_id") % 3 == 0, F.substring(F.sha2(root, 256), 1, 16))
           .when(F.col("page_id") % 3 == 1, P.default_project_name(root)).otherwise("missing"))
    asked = p.select(key.alias("key"), F.expr(f"timestampadd(SECOND, page_id, {fx.EPOCH})").alias("updated_at"))
    out = dml.use_project(asked, fx.resolution_projects(spark, sf))
    return out.withColumn("updated_at", F.col("updated_at").cast("string"))


def q_project_delete(spark, sf):
    projects = fx.context_projects(spark, sf)
    num = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    ids = projects.where(num % 5 == 0).select("id")
    docs, outs, sess, projs = dml.delete_projects(
        ids,
        ("documents", fx.context_documents(spark, sf), "project_id"),
        ("coding_outputs", fx.coding_outputs(spark, sf), "project_id"),
        ("session_entries", fx.session_entries(spark, sf), "project_id"),
        ("projects", projects, "id"),
    )
    return (docs.select(F.lit("documents").alias("table_name"), "id", "project_id")
            .unionByName(outs.select(F.lit("coding_outputs").alias("table_name"), "id", "project_id"))
            .unionByName(sess.select(F.lit("session_entries").alias("table_name"), "id", "project_id"))
            .unionByName(projs.select(F.lit("projects").alias("table_name"), "id",
                                      F.col("id").alias("project_id"))))


# --------------------------------------------------------------- context
def q_documents_by_project(spark, sf):
    return C.documents_by_project(fx.context_documents(spark, sf)).select("project_id", "relative_path", "id")


def q_listing_cap100(spark, sf):
    o = C.recent_outputs(fx.coding_outputs(spark, sf), L.LISTING_CAP).select(
        F.lit("coding_outputs").alias("table_name"), "project_id", "id", "recency_rank")
    s = C.recent_sessions(fx.session_entries(spark, sf), L.LISTING_CAP).select(
        F.lit("session_entries").alias("table_name"), "project_id", "id", "recency_rank")
    return o.unionByName(s)


def q_recent_outputs(spark, sf):
    return C.recent_outputs(fx.coding_outputs(spark, sf), STANDARD[0]).select("project_id", "id", "recency_rank")


def q_recent_sessions(spark, sf):
    return C.recent_sessions(fx.session_entries(spark, sf), STANDARD[1]).select("project_id", "id", "recency_rank")


def q_recent_doc_summaries(spark, sf):
    return C.recent_doc_summaries(fx.context_documents(spark, sf), STANDARD[2]) \
        .select("project_id", "id", "relative_path", "recency_rank")


def q_document_counts(spark, sf):
    return C.document_counts(fx.context_documents(spark, sf))


def q_token_counts(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", _n(tokenize("text")).alias("n_tokens"))


def _valid_requests(spark, sf) -> DataFrame:
    r = fx.plan_requests_input(spark, sf)
    req = L.requested_level("level", "compact_only", "full")
    return (r.withColumn("_req", req)
            .where(L.level_is_valid("_req"))
            .withColumn("level", L.normalize_level("_req"))
            .withColumn("doc_limit", L.max_docs("level"))
            .drop("_req"))


def q_detail_levels(spark, sf):
    r = fx.plan_requests_input(spark, sf)
    req = L.requested_level("level", "compact_only", "full")
    lvl = L.normalize_level(req)
    return r.select("request_id", req.alias("requested"), lvl.alias("level"),
                    L.level_is_valid(req).alias("is_valid"),
                    L.max_outputs(lvl).cast("bigint").alias("max_outputs"),
                    L.max_sessions(lvl).cast("bigint").alias("max_sessions"),
                    L.max_docs(lvl).cast("bigint").alias("max_docs"))


def q_relevance_rank(spark, sf):
    ranked = C.rank_documents(_valid_requests(spark, sf), fx.context_documents(spark, sf))
    return ranked.select("request_id", "doc_id", "score", "recency_rank", "relevance_rank")


def _bundles(spark, sf, limits):
    return C.context_bundles(fx.context_projects(spark, sf), fx.coding_outputs(spark, sf),
                             fx.session_entries(spark, sf), fx.context_documents(spark, sf), *limits)


def q_recent_context(spark, sf):
    b = _bundles(spark, sf, STANDARD)
    return b.select(
        "project_id",
        _j(F.transform("outputs", lambda o: o["id"])).alias("output_ids"),
        _j(F.transform("sessions", lambda s: s["id"])).alias("session_ids"),
        _j(F.transform("docs", lambda d: d["relative_path"])).alias("doc_paths"),
    )


def q_recent_context_summaries(spark, sf):
    """The bundles of ``recent_context`` from summaries of three runs, two of them compacted."""
    base = shared_dir(spark, "summaries")
    tables = {"outputs": fx.coding_outputs(spark, sf), "sessions": fx.session_entries(spark, sf)}
    for i in range(3):
        for kind, df in tables.items():
            S.write_summary(df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i), kind, base, f"r{i}")
            if i == 1:
                S.compact(spark, kind, base, f"r{i}")
    S.write_summary(fx.context_documents(spark, sf), "documents", base, "r2")
    b = S.context_from_summaries(spark, fx.context_projects(spark, sf), base, *STANDARD)
    return b.select(
        "project_id",
        _j(F.transform("outputs", lambda o: o["id"])).alias("output_ids"),
        _j(F.transform("sessions", lambda s: s["id"])).alias("session_ids"),
        _j(F.transform("docs", lambda d: d["relative_path"])).alias("doc_paths"),
    )


def q_relevance_rank_tokens(spark, sf):
    ranked = C.rank_documents_by_token(_valid_requests(spark, sf), fx.context_documents(spark, sf))
    return ranked.select("request_id", "doc_id", "score", "recency_rank", "relevance_rank")


def q_project_listing(spark, sf):
    """One project's listings over tables in project buckets; the first run is made twice."""
    base, out = shared_dir(spark, "buckets"), []
    for name, df in (("coding_outputs", fx.coding_outputs(spark, sf)), ("session_entries", fx.session_entries(spark, sf))):
        for run in (0, 0, 1):
            jobs.append_rows(df.where(F.pmod(F.xxhash64("id"), F.lit(2)) == run), f"{base}/{name}", f"r{run}")
        own = read_project(spark, f"{base}/{name}", "src1")
        out.append(C.newest_per_project(own.select("project_id", "id", "created_at"), L.LISTING_CAP, "created_at")
                   .select(F.lit(name).alias("table_name"), "project_id", "id", "recency_rank"))
    return out[0].unionByName(out[1])


def q_project_status(spark, sf):
    s = C.project_status(fx.context_projects(spark, sf), fx.context_documents(spark, sf),
                         fx.session_entries(spark, sf))
    return s.select("project_id", "n_documents",
                    _j(F.transform("recent_sessions", lambda r: F.concat(
                        F.lit("["), r["type"], F.lit("] "), r["summary"]))).alias("recent_sessions"))


def _handoff(spark, sf, full=False, compact=False):
    return R.handoff_documents(_bundles(spark, sf, L.export_limits(full, compact)), GENERATED, compact=compact)


def q_handoff_export(spark, sf):
    return _handoff(spark, sf).select("project_id", "title", "document")


def q_handoff_steps(spark, sf):
    h = _handoff(spark, sf, full=True)
    return h.select("project_id", _n("execution_plan").alias("n_steps"), _j("execution_plan").alias("steps"),
                    _j("current_context").alias("context"))


def q_handoff_files(spark, sf):
    h = _handoff(spark, sf, compact=True)
    return h.select("project_id", _n("relevant_files").alias("n_files"),
                    _j(F.transform("relevant_files", lambda f: F.concat(f["path"], F.lit("="), f["reason"])))
                    .alias("files"), "document")


def q_plan_requests(spark, sf):
    req = _valid_requests(spark, sf)
    docs = fx.context_documents(spark, sf)
    bundles = _bundles(spark, sf, (L.MAX_CONTEXT_OUTPUTS, L.MAX_CONTEXT_SESSIONS, 0))
    ranked = C.rank_documents(req, docs)
    out = R.brief_requests(req, bundles, ranked, default_model="default")
    return out.select("request_id", "project_id", "level", "model",
                      F.col("messages")[1]["content"].alias("user_prompt"))


# ---------------------------------------------------------- model answers
def q_extract_json(spark, sf):
    r = fx.extraction_responses(spark, sf)
    return r.select("request_id", extract_json_block("content").alias("json_block"))


def _extraction_cols(df):
    return [F.col("summary"), F.col("goal")] + [_j(c).alias(c) for c in X.EXTRACTION_LISTS]


def q_parse_extractions(spark, sf):
    p = X.parse_extractions(fx.extraction_responses(spark, sf))
    return p.select("request_id", "ok", *_extraction_cols(p))


def _normalized(spark, sf):
    return X.normalize_outputs(fx.coding_outputs(spark, sf), fx.extraction_responses(spark, sf))


def q_normalize_outputs(spark, sf):
    o = _normalized(spark, sf)
    return o.select("id", "goal", *[_j(c).alias(c) for c in ("actions", "decisions", "blockers",
                                                              "next_actions", "files")])


def q_sessions_from_outputs(spark, sf):
    s = X.sessions_from_outputs(_normalized(spark, sf))
    return s.select("id", "project_id", "summary", "next_action", _j("related_files").alias("related_files"),
                    _j("open_questions").alias("open_questions"))


def _plans(spark, sf):
    return X.parse_plans(fx.plan_responses(spark, sf))


def q_parse_plans(spark, sf):
    p = _plans(spark, sf)
    return p.select("request_id", "ok", "title", "goal", "copy_ready_prompt",
                    _j("execution_plan").alias("execution_plan"),
                    _j("current_context").alias("current_context"),
                    _j(F.transform("relevant_files", lambda r: F.concat(r["path"], F.lit("="), r["reason"])))
                    .alias("relevant_files"))


def q_plan_sessions(spark, sf):
    s = X.plan_sessions(_plans(spark, sf))
    return s.select("id", "request_id", "summary", "next_action", _j("related_files").alias("related_files"))


def q_noop_plans(spark, sf):
    p = X.noop_plans(_valid_requests(spark, sf))
    return p.select("request_id", "title", "goal", "copy_ready_prompt", _n("execution_plan").alias("n_steps"))


def q_json_lists(spark, sf):
    o = fx.coding_outputs(spark, sf)
    enc = F.to_json("next_actions")
    dec = F.coalesce(F.from_json(enc, "array<string>"), F.array().cast("array<string>"))
    bad = F.coalesce(F.from_json(F.concat(F.lit("["), F.col("goal")), "array<string>"),
                     F.array().cast("array<string>"))
    return o.select("id", _n(dec).alias("n_items"), (dec == F.col("next_actions")).alias("roundtrip_ok"),
                    _n(bad).alias("n_malformed_items"))


# ------------------------------------------------------------------ hooks
def _transcripts(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return c.select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit("/"),
                             F.col("turn").cast("string"), F.lit(".jsonl")).alias("transcript_path"),
                    F.col("text").alias("transcript"))


def _payload_texts(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn")
    cid, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    tpath = F.when(F.col("turn") % 5 == 4, F.lit("")).otherwise(
        F.concat(F.lit("/t/"), cid, F.lit("/"), turn, F.lit(".jsonl")))
    place = F.concat(F.lit('"/w/src'), (F.col("conv_id") % 20).cast("string"), F.lit('/sub"'))
    k = F.col("conv_id") % 11
    cwd = (F.when(k == 2, F.lit("")).when(k == 3, F.lit(', "cwd": null'))
           .when(k == 4, F.concat(F.lit(', "CWD": '), place))
           .when(k == 5, F.concat(F.lit(', "cwd": "/nowhere", "cwd": '), place))
           .otherwise(F.concat(F.lit(', "cwd": '), place)))
    body = F.concat(F.lit('{"session_id": "s'), cid, F.lit("-"), turn, F.lit('", "transcript_path": "'), tpath,
                    F.lit('"'), cwd, F.lit(', "hook_event_name": "Stop"}'))
    wrong = F.concat(F.lit('{"session_id": '), cid, F.lit(', "transcript_path": "'), tpath, F.lit('"}'))
    k = (F.col("conv_id") + F.col("turn")) % 7
    text = F.when(k == 0, F.substring(body, 1, 20)).when(k == 1, wrong).otherwise(body)
    return c.select(text.alias("payload"))


def q_hook_payloads(spark, sf):
    from briefloom.sources.hooks import ingest_hook_payloads
    projects = fx.context_projects(spark, sf)
    active = projects.agg(F.lit(J.ACTIVE_KEY).alias("key"), F.max("id").alias("value"))
    return ingest_hook_payloads(_payload_texts(spark, sf), _transcripts(spark, sf), projects, active)


def q_hook_outputs(spark, sf):
    from briefloom.sources.hooks import hook_texts
    projects = fx.context_projects(spark, sf)
    active = projects.agg(F.lit(J.ACTIVE_KEY).alias("key"), F.max("id").alias("value"))
    outputs = X.outputs_from_texts(hook_texts(_payload_texts(spark, sf), _transcripts(spark, sf), projects, active),
                                   "batch-1", INGESTED_AT)
    asked = X.extraction_requests(outputs).select("request_id", F.col("output_id").alias("id"),
                                                  F.length(F.col("messages")[1]["content"]).cast("bigint").alias("n_chars"))
    told = X.sessions_from_outputs(outputs).select(F.col("id").alias("session_id"), "summary")
    return (outputs.select("id", "project_id", "source").join(asked, "id")
            .join(told, F.sha2(F.concat(F.lit("session|"), "id"), 256) == F.col("session_id"))
            .select("id", "project_id", "source", "request_id", "n_chars", "summary"))


# ----------------------------------------------------------------- inbox
def _inbox_stream(spark, sf):
    events = read_table(spark, sf, "events")
    stream = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf))
    uid, et = F.col("user_id"), F.col("event_type")
    return stream.select(
        F.col("event_id").alias("arrival_id"),
        fx.inbox_path(uid, et).alias("path"),
        fx.inbox_content(uid, et).alias("content"),
        F.concat(F.lit("src"), (uid % 20).cast("string")).alias("project_id"),
    )


def _drain(spark, df, purpose):
    base = shared_dir(spark, purpose)
    I.run_to_table(df, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


def q_inbox_stream(spark, sf):
    acc = I.accepted(_inbox_stream(spark, sf))
    return _drain(spark, acc.select("arrival_id", "path", "project_id"), "inbox-stream")


def q_inbox_dedup(spark, sf):
    d = I.dedupe_paths(I.accepted(_inbox_stream(spark, sf)))
    out = _drain(spark, d.select("path", "project_id", "content"), "inbox-dedup")
    return out.select("path", "project_id", F.octet_length("content").cast("bigint").alias("n_bytes"))


def q_inbox_sessions(spark, sf):
    base = shared_dir(spark, "inbox-ingest")
    q = I.run_inbox(_inbox_stream(spark, sf), f"{base}/out", f"{base}/ckpt", INGESTED_AT)
    q.awaitTermination()
    s = spark.read.parquet(f"{base}/out/sessions")
    o = spark.read.parquet(f"{base}/out/outputs").select(F.col("id").alias("output_id"), "source")
    return (s.join(o, F.sha2(F.concat(F.lit("session|"), F.col("output_id")), 256) == F.col("id"))
            .select("project_id", "source", "summary", "next_action"))


def q_inbox_rejects(spark, sf):
    return _drain(spark, I.rejected(_inbox_stream(spark, sf)), "inbox-rejects")


def _watched(spark, sf):
    """The inbox job over a folder of files made from the turns; returns its output folder."""
    base = local_path(shared_dir(spark, "inbox-watch"))
    fx.write_files(fx.inbox_files(spark, sf, f"{base}/inbox"))
    W.watch_inbox(spark, f"{base}/inbox", f"file:{base}/out", f"file:{base}/ckpt", "src1", INGESTED_AT).awaitTermination()
    return f"file:{base}/out"


def q_inbox_watch(spark, sf):
    out = _watched(spark, sf)
    outputs = spark.read.parquet(f"{out}/coding_outputs").select("id", "project_id", "source", "raw_text")
    asked = spark.read.parquet(f"{out}/llm_requests").select(F.col("output_id").alias("id"), F.length(F.element_at("messages", -1)["content"]).alias("asked"))
    moved = spark.read.parquet(f"{out}/archived").select(F.col("src").alias("source"), P.base_name("dst").alias("archived"), "moved")
    return (outputs.join(asked, "id").join(moved, "source")
            .select("project_id", P.base_name("source").alias("name"), F.octet_length("raw_text").cast("bigint").alias("n_bytes"),
                    F.sha2("raw_text", 256).alias("hash"), F.col("asked").cast("bigint").alias("asked"), "archived", "moved"))


def q_inbox_dead_letters(spark, sf):
    return (spark.read.parquet(f"{_watched(spark, sf)}/inbox_rejects")
            .select(P.base_name("path").alias("name"), "reason"))


def q_live_tree_scan(spark, sf):
    base = local_path(shared_dir(spark, "live-tree"))
    fx.write_files(fx.tree_files(spark, sf, base))
    files = manifest_from_tree(spark, f"{base}/w", "all") if os.path.isdir(f"{base}/w") else fx.manifest(spark, sf).limit(0)
    return scan_manifest(files).select("relative_path", "kind", "size", "hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manifest_scan": q_manifest_scan,
    "content_hash": q_content_hash,
    "kind_distribution": q_kind_distribution,
    "relative_paths": q_relative_paths,
    "incremental_scan": q_incremental_scan,
    "incremental_scan_next": q_incremental_scan_next,
    "ingest_diff": q_ingest_diff,
    "ingest_diff_folders": q_ingest_diff_folders,
    "incremental_export": q_incremental_export,
    "recent_context_summaries": q_recent_context_summaries,
    "relevance_rank_tokens": q_relevance_rank_tokens,
    "project_listing": q_project_listing,
    "ingest_summary": q_ingest_summary,
    "ingest_sessions": q_ingest_sessions,
    "session_append": q_session_append,
    "document_upsert": q_document_upsert,
    "settings_latest": q_settings_latest,
    "project_list": q_project_list,
    "resolve_project": q_resolve_project,
    "resolve_project_modes": q_resolve_project_modes,
    "project_lookup": q_project_lookup,
    "project_register": q_project_register,
    "project_update": q_project_update,
    "project_use": q_project_use,
    "project_delete": q_project_delete,
    "documents_by_project": q_documents_by_project,
    "listing_cap100": q_listing_cap100,
    "recent_outputs": q_recent_outputs,
    "recent_sessions": q_recent_sessions,
    "recent_doc_summaries": q_recent_doc_summaries,
    "document_counts": q_document_counts,
    "token_counts": q_token_counts,
    "detail_levels": q_detail_levels,
    "relevance_rank": q_relevance_rank,
    "recent_context": q_recent_context,
    "project_status": q_project_status,
    "handoff_export": q_handoff_export,
    "handoff_steps": q_handoff_steps,
    "handoff_files": q_handoff_files,
    "plan_requests": q_plan_requests,
    "extract_json": q_extract_json,
    "parse_extractions": q_parse_extractions,
    "normalize_outputs": q_normalize_outputs,
    "sessions_from_outputs": q_sessions_from_outputs,
    "parse_plans": q_parse_plans,
    "plan_sessions": q_plan_sessions,
    "noop_plans": q_noop_plans,
    "json_lists": q_json_lists,
    "hook_payloads": q_hook_payloads,
    "hook_outputs": q_hook_outputs,
    "inbox_stream": q_inbox_stream,
    "inbox_dedup": q_inbox_dedup,
    "inbox_sessions": q_inbox_sessions,
    "inbox_rejects": q_inbox_rejects,
    "inbox_watch": q_inbox_watch,
    "inbox_dead_letters": q_inbox_dead_letters,
    "live_tree_scan": q_live_tree_scan,
}
