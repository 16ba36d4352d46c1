"""Adapters that derive the engine's input tables from the driver's test tables.

The reference keeps projects, documents, agent outputs and sessions in a
store we do not have; these views build the same shapes from ``documents``,
``conversations``, ``events``, ``pages`` and ``benchmark`` with plain column
rules, so every job's work grows with the test tables.  The DuckDB twins of
these rules live in ``briefloom.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import paths as P
from briefloom.sources.tables import read_table

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def _minutes(col: str) -> Column:
    return F.expr(f"timestampadd(MINUTE, {col}, {EPOCH})")


def _seconds(col: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {col}, {EPOCH})")


def _pick(key: Column, values: list) -> Column:
    """values[key] for a 0-based integer key."""
    expr = F.when(F.lit(False), F.lit(None))
    for i, v in enumerate(values):
        expr = expr.when(key == i, v if isinstance(v, Column) else F.lit(v))
    return expr


def _empty_list() -> Column:
    return F.array().cast("array<string>")


# --------------------------------------------------------------------------
# Corpus manifest (S1 input) and its two snapshots for the diff.
# --------------------------------------------------------------------------
MANIFEST_DIRS = ["src", "node_modules/pkg", ".git/objects", "Docs", ".vscode/x", "lib/Vendor"]
CORPUS_DIRS = ["src", "Docs", "cmd/app", "internal/x", "pages", "lib"]
# Every LARGE-th file gets this size: over the default ceiling.
LARGE = 101
LARGE_BYTES = 3 << 20
# Every UNREADABLE-th file of the current scan has no digest.
UNREADABLE = 89


def manifest(spark: SparkSession, sf_dir: str, dirs: list[str] | None = None) -> DataFrame:
    """One row per file: project_id, root, path, size, mtime, hash, prev_hash, doc_id, is_symlink.

    The default folders exercise the filters; with ``CORPUS_DIRS`` all but a
    few files (ignored names, symlinks, large ones) pass.
    """
    corpus = dirs is not None
    dirs = dirs or MANIFEST_DIRS
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    i = F.col("doc_id")
    s = i.cast("string")
    base = _pick(i % 12, [
        F.concat(F.lit("f"), s, F.lit(".go")),
        F.concat(F.lit("f"), s, F.lit(".py")),
        F.concat(F.lit("f"), s, F.lit(".md")),
        F.concat(F.lit("f"), s, F.lit(".txt")),
        F.concat(F.lit("f"), s, F.lit(".json")),
        F.concat(F.lit("f"), s, F.lit(".ts" if corpus else ".PNG")),
        F.concat(F.lit("f"), s, F.lit(".css" if corpus else ".min.js")),
        F.concat(F.lit("m"), s, F.lit("/Makefile")),
        F.concat(F.lit("f"), s, F.lit(".GO")),
        F.concat(F.lit("p"), s, F.lit("/package-lock.json")),
        F.concat(F.lit("e"), s, F.lit("/.env.example")),
        F.concat(F.lit("r"), s, F.lit("/README")),
    ])
    root = F.concat(F.lit("/w/"), F.col("source"))
    path = F.concat(root, F.lit("/"), _pick(i % 6, dirs), F.lit("/"), base)
    return d.select(
        "doc_id",
        F.col("source").alias("project_id"),
        root.alias("root"),
        path.alias("path"),
        F.when(i % LARGE == 50, F.lit(LARGE_BYTES) + i).otherwise(F.octet_length("text")).cast("bigint").alias("size"),
        _minutes("doc_id").alias("mtime"),
        F.sha2("text", 256).alias("hash"),
        F.when(i % 7 == 0, F.sha2(F.concat("text", F.lit("~")), 256))
         .otherwise(F.sha2("text", 256)).alias("prev_hash"),
        (i % 97 == 96).alias("is_symlink"),
    )


def current_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk now: the corpus minus every 13th file; a few can't be read."""
    m = manifest(spark, sf_dir, CORPUS_DIRS).where(F.col("doc_id") % 13 != 0).drop("prev_hash")
    return m.withColumn("hash", F.when(F.col("doc_id") % UNREADABLE != 5, F.col("hash")))


def ingest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, root): each project's own root, and for every fourth an empty second one."""
    r = manifest(spark, sf_dir, CORPUS_DIRS).select("project_id", "root").distinct()
    num = F.regexp_extract("project_id", r"(\d+)$", 1).cast("bigint")
    return r.unionByName(r.where(num % 4 == 0).withColumn("root", F.concat("root", F.lit("-extra"))))


def previous_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table as left by the previous run (schema ``DOCUMENTS``)."""
    from briefloom.operators.manifest import scan_manifest, document_key

    m = manifest(spark, sf_dir, CORPUS_DIRS).where(F.col("doc_id") % 11 != 0)
    kept = scan_manifest(m.withColumn("hash", F.col("prev_hash")))
    return kept.select(
        document_key("project_id", "relative_path").alias("id"),
        "project_id", "path", "relative_path", "kind", "hash", "size",
        F.col("mtime").alias("modified_at"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("summary of "), F.col("relative_path"))).alias("summary"),
        (F.col("doc_id") % 3 == 0).alias("raw_stored"),
        F.expr("TIMESTAMP_NTZ'2023-12-01 00:00:00'").alias("created_at"),
    )


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, relative_path, summary): what an extraction made of every third document."""
    from briefloom.operators.manifest import scan_manifest

    text = read_table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("summary"))
    kept = scan_manifest(current_scan(spark, sf_dir).where(F.col("doc_id") % 3 == 1))
    return kept.join(text, "doc_id").select("project_id", "relative_path", "summary")


# --------------------------------------------------------------------------
# Context tables: documents with summaries, agent outputs, sessions, projects.
# --------------------------------------------------------------------------
def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"),
        F.col("source").alias("project_id"),
        F.concat("lang", F.lit("/"), i.cast("string"), F.lit(".md")).alias("relative_path"),
        F.lit("markdown").alias("kind"),
        F.when(i % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("summary"),
        _minutes("doc_id").alias("modified_at"),
    )


def coding_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent outputs (schema ``CODING_OUTPUTS``) from assistant turns."""
    c = (read_table(spark, sf_dir, "conversations")
         .where(F.col("role") == "assistant")
         .select("conv_id", "turn", "text"))
    cid, turn = F.col("conv_id"), F.col("turn")
    first = F.substring_index("text", "\n", 1)
    return c.select(
        F.concat(cid.cast("string"), F.lit("-"), turn.cast("string")).alias("id"),
        F.concat(F.lit("src"), (cid % 20).cast("string")).alias("project_id"),
        F.concat(F.lit("agent/"), cid.cast("string"), F.lit("/"), turn.cast("string"),
                 F.lit(".md")).alias("source"),
        F.col("text").alias("raw_text"),
        F.when(turn % 3 == 0, F.lit("")).otherwise(first).alias("goal"),
        F.when(turn % 4 == 1, F.array(first)).otherwise(_empty_list()).alias("actions"),
        F.when(cid % 3 == 0, F.array(F.concat(F.lit("src/f"), cid.cast("string"), F.lit(".go")),
                                     F.concat(F.lit("docs/n"), turn.cast("string"), F.lit(".md"))))
         .otherwise(_empty_list()).alias("files"),
        F.when(turn % 4 == 3, _empty_list())
         .otherwise(F.array(F.concat(F.lit("decided "), cid.cast("string")))).alias("decisions"),
        F.when(cid % 5 == 0, F.array(F.lit("waiting on review"))).otherwise(_empty_list()).alias("blockers"),
        F.split("text", "\n").alias("next_actions"),
        _empty_list().alias("validation_notes"),
        _empty_list().alias("commit_recommendations"),
        _minutes("conv_id * 16 + turn").alias("created_at"),
    )


SESSION_TYPE_BY_EVENT = {
    "view": "spit", "click": "coding_output_ingest", "error": "file_ingest",
    "purchase": "folder_ingest", "signup": "export",
}


def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session history (schema ``SESSION_ENTRIES``) from events."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    etype = F.col("event_type")
    stype = F.when(F.lit(False), F.lit(None))
    for k, v in SESSION_TYPE_BY_EVENT.items():
        stype = stype.when(etype == k, v)
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project_id"),
        stype.otherwise("manual").alias("type"),
        F.concat(etype, F.lit(":"), F.col("props")).alias("summary"),
        _empty_list().alias("related_files"),
        _empty_list().alias("decisions"),
        _empty_list().alias("open_questions"),
        F.when(F.col("value") < 50, F.lit(""))
         .otherwise(F.concat(F.lit("follow up "), F.col("event_id").cast("string"))).alias("next_action"),
        F.col("ts").alias("created_at"),
    )


def context_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per document source (schema ``PROJECTS``)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    g = d.groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    return g.select(
        F.col("source").alias("id"),
        F.concat(F.lit("proj-"), F.col("source")).alias("name"),
        F.concat(F.lit("/w/"), F.col("source")).alias("root_path"),
        F.when(num % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Corpus "), F.col("source"))).alias("summary"),
        _empty_list().alias("tags"),
        F.when(num % 3 == 0, _empty_list())
         .otherwise(F.array(F.concat(F.lit("ship "), F.col("source")),
                            F.concat(F.lit("review "), F.col("source")))).alias("active_goals"),
        _minutes("first_doc").alias("created_at"),
        _minutes("first_doc").alias("updated_at"),
    )


# --------------------------------------------------------------------------
# Path resolution: projects rooted at hosts / host+language, cwds from urls.
# --------------------------------------------------------------------------
def _host(url: str = "url") -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def _url_path(url: str = "url") -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)


def resolution_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects rooted at '/<host>' and '/<host>/<lang>' (nested roots), plus
    one project with an empty root that detection must skip."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host = _host()
    lang = F.regexp_extract(_url_path(), r"^/([^/]+)", 1)
    roots = p.select(
        "page_id",
        F.explode(F.array(F.concat(F.lit("/"), host),
                          F.concat(F.lit("/"), host, F.lit("/"), lang))).alias("root_path"),
    )
    g = roots.groupBy("root_path").agg(F.min("page_id").alias("first_page"))
    projects = g.select(
        F.substring(F.sha2("root_path", 256), 1, 16).alias("id"),
        P.default_project_name("root_path").alias("name"),
        "root_path",
        _seconds("first_page").alias("created_at"),
    )
    empty_root = (p.groupBy().agg(F.min("page_id").alias("first_page"))
                  .select(F.lit("p-unrooted").alias("id"), F.lit("unrooted").alias("name"),
                          F.lit("").alias("root_path"), _seconds("first_page").alias("created_at")))
    return projects.unionByName(empty_root)


def resolution_cwds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    cwd = F.regexp_replace(F.concat(F.lit("/"), _host(), _url_path()), "/+$", "")
    return p.select(F.col("page_id").alias("cwd_id"), cwd.alias("cwd"))


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append log of settings writes (schema ``PROJECT_SETTINGS``): each page
    visit sets the active project to its host's project; every 4th also
    writes a display setting."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    active = p.select(
        F.lit("active_project_id").alias("key"),
        F.substring(F.sha2(F.concat(F.lit("/"), _host()), 256), 1, 16).alias("value"),
        _seconds("page_id").alias("updated_at"),
    )
    other = p.where(F.col("page_id") % 4 == 0).select(
        F.lit("display").alias("key"),
        F.concat(F.lit("mode-"), (F.col("page_id") % 3).cast("string")).alias("value"),
        _seconds("page_id").alias("updated_at"),
    )
    return active.unionByName(other)


# --------------------------------------------------------------------------
# Model-call tables: brief requests, extraction and plan responses.
# --------------------------------------------------------------------------
REQUEST_LEVELS = ["", "compact", "standard", "full", "bogus"]


def plan_requests_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, project_id, goal, level, compact_only, full, model_override)."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    i = F.col("item_id")
    return b.select(
        F.concat(F.lit("r"), i.cast("string")).alias("request_id"),
        F.concat(F.lit("src"), (i % 21).cast("string")).alias("project_id"),  # no project has src20
        F.col("text").alias("goal"),
        _pick(i % 5, REQUEST_LEVELS).alias("level"),
        (i % 7 == 0).alias("compact_only"),
        (i % 7 == 1).alias("full"),
        F.when(i % 2 == 0, F.lit("")).otherwise(F.lit("model-b")).alias("model_override"),
    )


def extraction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, output_id, content, error) -- model answers to extraction
    requests, one per assistant turn, in seven shapes: bare JSON, fenced,
    upper-case fence, prose-wrapped, wrong type, two objects, plain text.
    The summary is the whole turn, escaped."""
    c = (read_table(spark, sf_dir, "conversations")
         .where(F.col("role") == "assistant")
         .select("conv_id", "turn", "text"))
    packed = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("v")))
    quoted = F.substring(packed, F.lit(6), F.length(packed) - 6)
    cid, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    key = F.col("conv_id") * 16 + F.col("turn")
    body = F.concat(
        F.lit('{"summary": '), quoted, F.lit(', "goal": "finish task '), cid,
        F.lit('", "actions": ["edit f'), cid, F.lit('.go", null], "decisions": [], "blockers": null'),
        F.lit(', "next_actions": ["test '), cid, F.lit('", "ship '), turn,
        F.lit('"], "files_mentioned": ["f'), cid, F.lit('.go"], "extra": {"k": '), turn, F.lit("}}"),
    )
    wrong = F.concat(F.lit('{"summary": "x", "goal": '), turn, F.lit(', "actions": []}'))
    content = _pick(key % 7, [
        body,
        F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")),
        F.concat(F.lit("```JSON\n"), body, F.lit("\n```")),
        F.concat(F.lit("Result: "), body, F.lit(" -- end")),
        wrong,
        F.concat(body, F.lit("\n"), body),
        F.concat(F.lit("no structured output for turn "), turn),
    ])
    return c.select(
        F.concat(F.lit("x"), cid, F.lit("-"), turn).alias("request_id"),
        F.concat(cid, F.lit("-"), turn).alias("output_id"),
        F.when(key % 11 == 10, F.lit(None).cast("string")).otherwise(content).alias("content"),
        F.when(key % 11 == 10, F.lit("timeout")).otherwise(F.lit("")).alias("error"),
    )


def plan_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, project_id, request_goal, content, error) -- model answers
    to brief requests, one per event, in six shapes."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    plan = F.concat(
        F.lit('{"title": "Plan '), eid, F.lit('", "goal": "fix '), F.col("event_type"),
        F.lit('", "why_now": "", "current_context": ["user '), uid,
        F.lit('"], "relevant_files": [{"path": "src/e'), eid, F.lit('.go", "reason": "hot"}, null, {"path": "docs/u'),
        uid, F.lit('.md"}], "execution_plan": ["step one '), eid,
        F.lit('", "step two"], "constraints": null, "validation": [], "expected_output": "ok", "copy_ready_prompt": "do '),
        eid, F.lit('"}'),
    )
    no_goal = F.concat(F.lit('{"title": "Empty '), eid, F.lit('", "goal": "", "copy_ready_prompt": ""}'))
    prompt_only = F.concat(F.lit('{"title": "T'), eid, F.lit('", "copy_ready_prompt": "only prompt '), eid,
                           F.lit('", "execution_plan": []}'))
    wrong = F.concat(F.lit('{"title": "W", "goal": "g", "execution_plan": "not a list '), eid, F.lit('"}'))
    k = F.col("event_id") % 6
    content = _pick(k, [
        plan,
        F.concat(F.lit("```json\n"), plan, F.lit("\n```")),
        no_goal,
        prompt_only,
        wrong,
        F.concat(F.lit("Sorry, I cannot plan event "), eid),
    ])
    return e.select(
        F.concat(F.lit("e"), eid).alias("request_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project_id"),
        F.concat(F.col("event_type"), F.lit(" task for user "), uid).alias("request_goal"),
        content.alias("content"),
        F.lit("").alias("error"),
    )


# --------------------------------------------------------------------------
# Inbox: files dropped into per-project inbox folders, from events.
# --------------------------------------------------------------------------
INBOX_FILE_EXTS = [".md", ".txt", ".json", ".log", ".MD", ".pdf"]


def inbox_path(user_id: Column, event_type: Column) -> Column:
    return F.concat(
        F.lit("/inbox/src"), (user_id % 20).cast("string"), F.lit("/"),
        event_type, F.lit("-"), user_id.cast("string"),
        _pick(user_id % 6, INBOX_FILE_EXTS),
    )


def inbox_content(user_id: Column, event_type: Column) -> Column:
    """The dropped file's text: a function of its path, so a re-drop of the
    same path carries the same bytes."""
    return F.when(user_id % 9 == 0, F.lit("")).otherwise(
        F.concat(F.lit("Agent run "), event_type, F.lit(" for user "), user_id.cast("string"),
                 F.lit("\nnext: review "), event_type))


# --------------------------------------------------------------------------
# Real files, written by tasks: a folder tree of documents, an inbox of turns.
# --------------------------------------------------------------------------
def _write_files(batches):
    import os

    import pyarrow as pa

    for b in batches:
        for path, text, link in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), b.column("link").to_pylist(), strict=True):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            new = f"{path}.{os.getpid()}.new"
            if link:
                os.symlink("/nowhere", new)
            else:
                with open(new, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            os.replace(new, path)
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])


def write_files(files: DataFrame) -> int:
    """Write (path, text, link) rows as files (or broken links) of a mounted folder; returns their number."""
    return files.mapInArrow(_write_files, "n long").agg(F.sum("n")).first()[0] or 0


def tree_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The manifest's files (default folders) below ``folder``, with whole texts."""
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return (manifest(spark, sf_dir).where(F.col("path").isNotNull()).select("doc_id", "path", F.col("is_symlink").alias("link"))
            .join(texts, "doc_id").select(F.concat(F.lit(folder), "path").alias("path"), "text", "link"))


def inbox_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Every turn as a file of an inbox, whole text; every ninth conversation's are empty."""
    t = read_table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    c, n = F.col("conv_id"), F.col("turn")
    return t.select(
        F.concat(F.lit(folder + "/t"), c.cast("string"), F.lit("-"), n.cast("string"), _pick((c + n) % 6, INBOX_FILE_EXTS)).alias("path"),
        F.when(c % 9 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.lit(False).alias("link"))
