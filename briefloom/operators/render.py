"""Text assembly: handoff documents (U1-U3, C7) and brief requests.

All text is built with native array/string functions over the per-project
context bundle, so rendering runs in the executors next to the data.  The
text formats live in ``briefloom.functions.formats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import formats as T
from briefloom.functions import levels as L
from briefloom.functions.formats import render
from briefloom.schemas import SESSION_EXPORT


def _lines(arr: Column, fmt) -> Column:
    """Concatenate one formatted line per element ('' for an empty array)."""
    return F.array_join(F.transform(arr, fmt), "")


def _section(cond: Column, text: Column) -> Column:
    return F.when(cond, text).otherwise(F.lit(""))


def _items(arr: Column, template: str) -> Column:
    return _lines(arr, lambda x: render(template, item=x))


def handoff_parts(bundles: DataFrame) -> DataFrame:
    """U1-U3 on a context bundle: current context, next steps, relevant files."""
    sess, outs, docs = F.col("sessions"), F.col("outputs"), F.col("docs")
    context = F.concat(F.col("active_goals"), F.transform(
        sess, lambda s: render(T.HANDOFF_CONTEXT_SESSION, type=s["type"], summary=s["summary"])))
    steps = F.concat(F.filter(F.transform(sess, lambda s: s["next_action"]), lambda a: a != ""),
                     F.flatten(F.transform(outs, lambda o: o["next_actions"])))
    files = F.concat(
        F.flatten(F.transform(outs, lambda o: F.transform(
            o["files"], lambda f: F.struct(f.alias("path"), F.lit(T.HANDOFF_FILE_REASON).alias("reason"))))),
        F.transform(docs, lambda d: F.struct(d["relative_path"].alias("path"), d["summary"].alias("reason"))),
    )
    return bundles.select("*", context.alias("current_context"), steps.alias("execution_plan"),
                          files.alias("relevant_files"))


def handoff_documents(bundles: DataFrame, generated: str, compact: bool = False) -> DataFrame:
    """The handoff plan fields and its markdown document, one row per project.

    ``generated`` is the 'YYYY-MM-DD HH:MM' stamp (a parameter, not the clock,
    so the output is deterministic).
    """
    b = handoff_parts(bundles)
    name, summary = F.col("name"), F.col("summary")
    goals, sess, outs, docs = F.col("active_goals"), F.col("sessions"), F.col("outputs"), F.col("docs")
    next_actions = F.flatten(F.transform(outs, lambda o: o["next_actions"]))
    full_view = F.lit(not compact)
    prompt = F.concat(
        render(T.HANDOFF_PROMPT_PROJECT, name=name),
        _section(summary != "", render(T.HANDOFF_PROMPT_DESCRIPTION, summary=summary)),
        _section(F.size(goals) > 0, F.concat(F.lit(T.HANDOFF_PROMPT_GOALS), _items(goals, T.HANDOFF_PROMPT_ITEM))),
        _section(F.size(sess) > 0, F.concat(F.lit(T.HANDOFF_PROMPT_PROGRESS), _items(
            F.transform(sess, lambda s: s["summary"]), T.HANDOFF_PROMPT_ITEM))),
        _section(F.size(next_actions) > 0, F.concat(F.lit(T.HANDOFF_PROMPT_NEXT),
                                                    _items(next_actions, T.HANDOFF_PROMPT_ITEM))),
        _section(full_view & (F.size(docs) > 0), F.concat(F.lit(T.HANDOFF_PROMPT_FILES), _lines(
            docs, lambda d: render(T.HANDOFF_PROMPT_FILE, path=d["relative_path"], summary=d["summary"])))),
    )
    title = render(T.HANDOFF_TITLE, name=name)
    goal = render(T.HANDOFF_GOAL, name=name)
    ctx, plan, files = F.col("current_context"), F.col("execution_plan"), F.col("relevant_files")
    numbered = F.transform(plan, lambda s, i: render(T.HANDOFF_DOC_STEP, n=(i + 1).cast("string"), step=s))
    end = F.lit(T.HANDOFF_DOC_SECTION_END)
    doc = F.concat(
        render(T.HANDOFF_DOC_HEAD, title=title, generated=generated),
        render(T.HANDOFF_DOC_PROJECT, name=name),
        _section(summary != "", render(T.HANDOFF_DOC_SUMMARY, summary=summary)),
        _section(F.size(ctx) > 0, F.concat(F.lit(T.HANDOFF_DOC_CONTEXT), _items(ctx, T.HANDOFF_DOC_ITEM), end)),
        _section(F.size(plan) > 0, F.concat(F.lit(T.HANDOFF_DOC_STEPS), F.array_join(numbered, ""), end)),
        _section(full_view & (F.size(files) > 0), F.concat(
            F.lit(T.HANDOFF_DOC_FILES),
            _lines(files, lambda f: F.when(f["reason"] != "", render(
                T.HANDOFF_DOC_FILE_REASON, path=f["path"], reason=f["reason"]))
                .otherwise(render(T.HANDOFF_DOC_FILE, path=f["path"]))),
            end)),
        render(T.HANDOFF_DOC_PROMPT, prompt=F.col("copy_ready_prompt")),
    )
    return (b.withColumn("copy_ready_prompt", prompt)
            .select("project_id", "name",
                    title.alias("title"), goal.alias("goal"),
                    F.when(summary != "", summary).otherwise(F.lit("")).alias("why_now"),
                    "current_context", "execution_plan", "relevant_files", "copy_ready_prompt",
                    render(T.HANDOFF_EXPECTED, goal=goal).alias("expected_output"),
                    doc.alias("document")))


def export_sessions(projects: DataFrame) -> DataFrame:
    """P20: the session row an export records."""
    return projects.select(F.col("id").alias("project_id"), F.lit(SESSION_EXPORT).alias("type"),
                           render(T.EXPORT_SUMMARY, name=F.col("name")).alias("summary"),
                           F.lit("").alias("next_action"))


def brief_user_prompt(bundle_cols: dict, ranked_docs: Column, goal: Column) -> Column:
    """The user message of a brief request (section order: project,
    goals, history, outputs, files, request; empty sections omitted)."""
    name, root, summary, goals = (bundle_cols[k] for k in ("name", "root_path", "summary", "active_goals"))
    sess, outs = bundle_cols["sessions"], bundle_cols["outputs"]
    end = F.lit(T.BRIEF_SECTION_END)

    project = F.concat(
        render(T.BRIEF_PROJECT, name=name),
        _section(root != "", render(T.BRIEF_ROOT, root=root)),
        _section(summary != "", render(T.BRIEF_DESCRIPTION, summary=summary)),
        _section(F.size(goals) > 0, F.concat(F.lit(T.BRIEF_GOALS), _items(goals, T.BRIEF_GOAL_ITEM))),
        end,
    )
    history = _section(F.size(sess) > 0, F.concat(
        F.lit(T.BRIEF_HISTORY),
        _lines(sess, lambda s: F.concat(
            render(T.BRIEF_SESSION, type=s["type"], summary=s["summary"]),
            _section(s["next_action"] != "", render(T.BRIEF_SESSION_NEXT, next_action=s["next_action"])))),
        end))

    def listed(arr, header):
        return _section(F.size(arr) > 0, F.concat(F.lit(header), _items(arr, T.BRIEF_OUTPUT_ITEM)))

    outputs = _section(F.size(outs) > 0, F.concat(
        F.lit(T.BRIEF_OUTPUTS),
        _lines(outs, lambda o: F.concat(
            _section(o["goal"] != "", render(T.BRIEF_OUTPUT_GOAL, goal=o["goal"])),
            listed(o["next_actions"], T.BRIEF_OUTPUT_NEXT),
            listed(o["blockers"], T.BRIEF_OUTPUT_BLOCKERS),
            listed(o["decisions"], T.BRIEF_OUTPUT_DECISIONS))),
        end))
    files = _section(F.size(ranked_docs) > 0, F.concat(
        F.lit(T.BRIEF_FILES),
        _lines(ranked_docs, lambda d: render(T.BRIEF_FILE, path=d["relative_path"], summary=d["summary"])),
        end))
    return F.concat(project, history, outputs, files, render(T.BRIEF_REQUEST, goal=goal))


def _system_prompt(system_prompt, level: Column) -> Column:
    """A caller-supplied system message: one string, or one per level."""
    if isinstance(system_prompt, dict):
        expr = F.when(F.lit(False), F.lit(None))
        for k, v in system_prompt.items():
            expr = expr.when(level == k, F.lit(v))
        return expr.otherwise(F.lit(system_prompt.get("standard", "")))
    return F.lit(system_prompt)


def brief_requests(requests: DataFrame, bundles: DataFrame, ranked: DataFrame, system_prompt="",
                   default_model: str = "default", max_tokens: int = 4096, temperature: float = 0.3) -> DataFrame:
    """C5 + P21: one model request per valid brief request of a known project
    (the job reports the others as rejects).

    ``requests``: (request_id, project_id, goal, level [normalised], model_override).
    ``bundles``: ``context_bundles`` built with the largest level limits; each
    request slices its own newest n.  ``ranked``: ``rank_documents`` output.
    ``system_prompt``: the system message text (prompt wording is the
    caller's), or a dict level -> text.
    """
    docs = (ranked.groupBy("request_id")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct(
                F.col("relevance_rank").alias("_r"), "relative_path", "summary"))),
                lambda s: s.dropFields("_r")).alias("ranked_docs")))
    j = (requests.join(bundles, "project_id").join(docs, "request_id", "left"))
    lvl = F.col("level")
    cols = {
        "name": F.col("name"), "root_path": F.col("root_path"), "summary": F.col("summary"),
        "active_goals": F.col("active_goals"),
        "sessions": F.slice(F.col("sessions"), 1, L.max_sessions(lvl)),
        "outputs": F.slice(F.col("outputs"), 1, L.max_outputs(lvl)),
    }
    ranked_docs = F.coalesce(F.col("ranked_docs"),
                             F.array().cast("array<struct<relative_path:string,summary:string>>"))
    user = brief_user_prompt(cols, ranked_docs, F.col("goal"))
    return j.select(
        "request_id", "project_id", "level",
        F.lit("plan").alias("kind"),
        F.array(F.struct(F.lit("system").alias("role"), _system_prompt(system_prompt, lvl).alias("content")),
                F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
        F.coalesce(F.nullif(F.col("model_override"), F.lit("")), F.lit(default_model)).alias("model"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).cast("float").alias("temperature"),
    )
