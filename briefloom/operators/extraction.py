"""Agent-output normalisation and model-response ingest.

The model call itself is outside Spark: pass 1 writes request rows, any
external runner answers them, pass 2 joins the answers back by request_id.
A missing or failed answer yields exactly the no-op planner's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import formats as T
from briefloom.functions.formats import render
from briefloom.functions.json_strict import strict_extraction, strict_plan
from briefloom.functions.text import extract_json_block
from briefloom.schemas import SESSION_OUTPUT_INGEST, SESSION_SPIT

EXTRACTION_LISTS = ["actions", "decisions", "blockers", "next_actions", "files_mentioned"]
PLAN_LISTS = ["current_context", "execution_plan", "constraints", "validation"]
FALLBACK_TITLE = T.FALLBACK_PLAN_TITLE


def first_or_empty(arr) -> Column:
    """First element or ''."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.coalesce(F.get(arr, 0), F.lit(""))


def one_answer(responses: DataFrame, key: str = "request_id") -> DataFrame:
    """At most one answer per request: a runner may write an answer more than
    once (retries).  A successful answer wins over a failed one, then the
    later ``attempt_at``, if the runner supplies that column; without it the
    larger content is kept, so that a re-run makes the same choice.  Partial
    aggregation before the shuffle pre-reduces a hot key."""
    cols = [c for c in responses.columns if c != key]
    ok = (F.coalesce(F.col("error"), F.lit("")) == "") & F.col("content").isNotNull()
    attempt = [F.col("attempt_at")] if "attempt_at" in responses.columns else []
    rank = F.struct(ok, *attempt, F.coalesce(F.col("content"), F.lit("")), F.coalesce(F.col("error"), F.lit("")))
    return (responses.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_a"))
            .select(key, *[F.col(f"_a.{c}").alias(c) for c in cols]))


def parse_extractions(responses: DataFrame) -> DataFrame:
    """P6 + P7 over (request_id, content, error).

    A parsed answer gives its fields (missing lists -> []); an answer that
    does not decode keeps the raw text as the summary with everything else
    empty; a missing/failed answer (error != '' or NULL content) gives the
    no-op result.  Adds ``ok`` (decoded) and ``answered``.
    """
    responses = one_answer(responses)
    answered = F.col("content").isNotNull() & (F.coalesce(F.col("error"), F.lit("")) == "")
    # The block is a column of its own: inside the decoder it would be cut out anew for each use.
    r = (responses.withColumn("_block", extract_json_block(F.col("content")))
         .withColumn("_p", F.when(answered, strict_extraction("_block"))).withColumn("_answered", answered))
    ok = F.col("_p").isNotNull()
    empty = F.array().cast("array<string>")
    cols = [F.when(ok, F.col("_p.summary")).when(F.col("_answered"), F.col("content"))
            .otherwise(F.lit("")).alias("summary"),
            F.when(ok, F.col("_p.goal")).otherwise(F.lit("")).alias("goal")]
    cols += [F.when(ok, F.col(f"_p.{c}")).otherwise(empty).alias(c) for c in EXTRACTION_LISTS]
    keep = [c for c in responses.columns if c not in ("content", "error")]
    return r.select(*keep, *cols, ok.alias("ok"), F.col("_answered").alias("answered"))


def fill_outputs(outputs: DataFrame, extractions: DataFrame, on: str = "id") -> DataFrame:
    """Field-wise fill of outputs from their extraction (own non-empty
    value wins); ``files`` takes ``files_mentioned``; the extracted summary
    is dropped.  ``extractions`` must be keyed by ``on`` (one row per output).
    """
    e = extractions.select(
        F.col(on).alias("_xid"), F.col("goal").alias("x_goal"),
        *[F.col(c).alias(f"x_{c}") for c in EXTRACTION_LISTS])
    j = outputs.join(e, outputs[on] == e["_xid"], "left").drop("_xid")

    def fill(own: str, ext: str) -> Column:
        x = F.col(f"x_{ext}")
        return F.when((F.size(F.col(own)) == 0) & x.isNotNull() & (F.size(x) > 0), x).otherwise(F.col(own))

    out = j.select(
        *[c for c in outputs.columns if c not in ("goal", "actions", "decisions", "blockers",
                                                   "next_actions", "files")],
        F.when(F.col("goal") == "", F.coalesce(F.col("x_goal"), F.lit(""))).otherwise(F.col("goal")).alias("goal"),
        fill("actions", "actions").alias("actions"),
        fill("decisions", "decisions").alias("decisions"),
        fill("blockers", "blockers").alias("blockers"),
        fill("next_actions", "next_actions").alias("next_actions"),
        fill("files", "files_mentioned").alias("files"),
    )
    return out.select(*outputs.columns)


def sessions_from_outputs(outputs: DataFrame) -> DataFrame:
    """P10 + P11: the session row recorded for each saved output."""
    summary = F.coalesce(F.nullif(F.col("goal"), F.lit("")),
                         F.nullif(F.get(F.col("actions"), 0), F.lit("")),
                         render(T.OUTPUT_SUMMARY_FALLBACK, source=F.col("source")))
    return outputs.select(
        F.sha2(F.concat(F.lit("session|"), F.col("id")), 256).alias("id"),
        "project_id",
        F.lit(SESSION_OUTPUT_INGEST).alias("type"),
        summary.alias("summary"),
        F.col("files").alias("related_files"),
        "decisions",
        F.col("blockers").alias("open_questions"),
        first_or_empty("next_actions").alias("next_action"),
        "created_at",
    )


def parse_plans(responses: DataFrame) -> DataFrame:
    """P6 + P8 over (request_id, request_goal, content, error).

    A decoded plan needs a goal or a prompt; otherwise (or when the answer
    does not decode) the fallback plan: title 'Session Brief', the request's
    goal, and the raw answer as the prompt.  A missing answer (no model was
    configured) gives the no-op plan (goal and prompt = request goal).  A
    failed call (error != '') is flagged ``call_failed``: the reference
    reports it to the user and records nothing.  Adds ``ok``.
    """
    responses = one_answer(responses)
    answered = F.col("content").isNotNull() & (F.coalesce(F.col("error"), F.lit("")) == "")
    p = F.col("_p")
    valid = p.isNotNull() & ~((p["goal"] == "") & (p["copy_ready_prompt"] == ""))
    r = (responses.withColumn("_block", extract_json_block(F.col("content")))
         .withColumn("_p", F.when(answered, strict_plan("_block"))))
    empty = F.array().cast("array<string>")
    refs_empty = F.array().cast("array<struct<path:string,reason:string>>")

    def s(field, fallback):
        return F.when(valid, p[field]).otherwise(fallback).alias(field)

    keep = [c for c in responses.columns if c not in ("content", "error")]
    return r.select(
        *keep,
        s("title", F.lit(FALLBACK_TITLE)),
        s("goal", F.col("request_goal")),
        s("why_now", F.lit("")),
        *[s(c, empty) for c in PLAN_LISTS[:1]],
        s("relevant_files", refs_empty),
        *[s(c, empty) for c in PLAN_LISTS[1:]],
        s("expected_output", F.lit("")),
        s("copy_ready_prompt", F.when(answered, F.col("content")).otherwise(F.col("request_goal"))),
        valid.alias("ok"),
        (F.coalesce(F.col("error"), F.lit("")) != "").alias("call_failed"),
    )


def noop_plans(requests: DataFrame) -> DataFrame:
    """The no-op planner's answer to each request."""
    empty = F.array().cast("array<string>")
    return requests.select(
        "request_id", "project_id",
        F.lit(FALLBACK_TITLE).alias("title"), F.col("goal"), F.lit("").alias("why_now"),
        empty.alias("current_context"),
        F.array().cast("array<struct<path:string,reason:string>>").alias("relevant_files"),
        empty.alias("execution_plan"), empty.alias("constraints"), empty.alias("validation"),
        F.lit("").alias("expected_output"), F.col("goal").alias("copy_ready_prompt"),
    )


def plan_sessions(plans: DataFrame) -> DataFrame:
    """C6 + P12 + P20: the two session rows recorded per brief (none for a
    failed call).  Both rows come out of one pass over ``plans`` (an
    ``explode`` of a two-element array), so the parse above runs once."""
    if "call_failed" in plans.columns:
        plans = plans.where(~F.col("call_failed"))
    no_files = F.array().cast("array<string>")
    rows = F.array(
        F.struct(F.lit(1).alias("seq"),
                 render(T.SPIT_SUMMARY, goal=F.col("request_goal"), title=F.col("title")).alias("summary"),
                 no_files.alias("related_files"), F.lit("").alias("next_action")),
        F.struct(F.lit(2).alias("seq"),
                 render(T.PLAN_SUMMARY, title=F.col("title"), goal=F.col("goal")).alias("summary"),
                 F.transform("relevant_files", lambda r: r["path"]).alias("related_files"),
                 first_or_empty("execution_plan").alias("next_action")),
    )
    both = plans.select("request_id", "project_id", F.explode(rows).alias("s")).select(
        "request_id", "project_id", "s.seq", F.lit(SESSION_SPIT).alias("type"),
        "s.summary", "s.related_files", "s.next_action")
    return both.withColumn("id", F.sha2(F.concat_ws("|", F.lit("spit"), "request_id", F.col("seq").cast("string")), 256))


def outputs_from_texts(texts: DataFrame, batch_id: str, created_at: str) -> DataFrame:
    """C2 pass 0: raw agent outputs (project_id, source, raw_text) as
    ``CODING_OUTPUTS`` rows with empty lists.  The id hashes project, source,
    content and the ingest batch: a retry of one batch gives the same ids,
    while the same text ingested in a later batch is a new output (as in the
    reference)."""
    empty = F.array().cast("array<string>")
    oid = F.sha2(F.concat_ws("|", F.col("project_id"), F.col("source"), F.sha2(F.col("raw_text"), 256),
                             F.lit(batch_id)), 256)
    return texts.select(
        oid.alias("id"), "project_id", "source", "raw_text", F.lit("").alias("goal"),
        empty.alias("actions"), empty.alias("files"), empty.alias("decisions"), empty.alias("blockers"),
        empty.alias("next_actions"), empty.alias("validation_notes"), empty.alias("commit_recommendations"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def extraction_requests(outputs: DataFrame, system_prompt: str = "", model: str = "default") -> DataFrame:
    """E2 pass 1: one extraction request per output (1024 tokens, temperature 0.1)."""
    return outputs.select(
        F.concat(F.lit("x"), F.col("id")).alias("request_id"),
        F.col("id").alias("output_id"), "project_id",
        F.lit("extract").alias("kind"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("raw_text").alias("content"))).alias("messages"),
        F.lit(model).alias("model"), F.lit(1024).alias("max_tokens"), F.lit(0.1).cast("float").alias("temperature"),
    )


def normalize_outputs(outputs: DataFrame, responses: DataFrame, reject_empty: bool = False) -> DataFrame:
    """Outputs filled from their extraction answers (E2 pass 2).

    ``responses``: (request_id, output_id, content, error).  Outputs without
    an answer keep their own values (the no-op extractor).  With
    ``reject_empty`` (the explicit-path ingest) empty raw texts are dropped.
    """
    if reject_empty:
        outputs = outputs.where(F.length("raw_text") > 0)
    ex = parse_extractions(responses)
    # one extraction per output even if an output was asked twice: a decoded
    # answer wins, then the later request id (hash aggregate, no fan-out)
    fields = F.struct("goal", *EXTRACTION_LISTS)
    e = (ex.groupBy(F.col("output_id").alias("id"))
         .agg(F.max_by(fields, F.struct("ok", "request_id")).alias("_x"))
         .select("id", "_x.*"))
    return fill_outputs(outputs, e, on="id")
