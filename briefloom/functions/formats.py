"""Text formats of the rows and documents the engine writes, and a renderer.

Templates use ``{field}`` placeholders; ``render`` turns one into a native
``concat`` of literals and columns (so text is assembled in the JVM), and
``render_sql`` into the equivalent SQL expression for the DuckDB twins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Output text formats (must equal the reference's), in the
# order the reference writes them.
# ---------------------------------------------------------------------------
# Brief request (user message).
UNKNOWN_LEVEL = 'unknown detail level "%s": use compact, standard, or detailed'
UNKNOWN_PROJECT = "project not found"
BRIEF_PROJECT = "PROJECT: {name}\n"
BRIEF_ROOT = "ROOT: {root}\n"
BRIEF_DESCRIPTION = "DESCRIPTION: {summary}\n"
BRIEF_GOALS = "ACTIVE GOALS:\n"
BRIEF_GOAL_ITEM = "  - {item}\n"
BRIEF_SECTION_END = "\n"
BRIEF_HISTORY = "RECENT SESSION HISTORY:\n"
BRIEF_SESSION = "  [{type}] {summary}\n"
BRIEF_SESSION_NEXT = "    → next: {next_action}\n"
BRIEF_OUTPUTS = "RECENT CODING AGENT OUTPUTS:\n"
BRIEF_OUTPUT_GOAL = "  Goal: {goal}\n"
BRIEF_OUTPUT_NEXT = "  Next actions:\n"
BRIEF_OUTPUT_BLOCKERS = "  Blockers:\n"
BRIEF_OUTPUT_DECISIONS = "  Decisions:\n"
BRIEF_OUTPUT_ITEM = "    - {item}\n"
BRIEF_FILES = "RELEVANT PROJECT FILES:\n"
BRIEF_FILE = "  [{path}] {summary}\n"
BRIEF_REQUEST = "DEVELOPER REQUEST: {goal}\n"

# Handoff plan fields.
HANDOFF_TITLE = "Handoff: {name}"
HANDOFF_GOAL = "Continue development of {name}"
HANDOFF_CONTEXT_SESSION = "[{type}] {summary}"
HANDOFF_FILE_REASON = "mentioned in recent coding output"
HANDOFF_EXPECTED = "Continued development on {goal}"
# Handoff copy-ready prompt.
HANDOFF_PROMPT_PROJECT = "Project: {name}\n"
HANDOFF_PROMPT_DESCRIPTION = "Description: {summary}\n"
HANDOFF_PROMPT_GOALS = "Goals:\n"
HANDOFF_PROMPT_ITEM = "  - {item}\n"
HANDOFF_PROMPT_PROGRESS = "\nRecent progress:\n"
HANDOFF_PROMPT_NEXT = "\nSuggested next actions:\n"
HANDOFF_PROMPT_FILES = "\nKey files:\n"
HANDOFF_PROMPT_FILE = "  - {path}: {summary}\n"
# Handoff markdown document.
HANDOFF_DOC_HEAD = "# {title}\n\nGenerated: {generated}\n\n"
HANDOFF_DOC_PROJECT = "## Project: {name}\n\n"
HANDOFF_DOC_SUMMARY = "{summary}\n\n"
HANDOFF_DOC_CONTEXT = "## Current Context\n\n"
HANDOFF_DOC_ITEM = "- {item}\n"
HANDOFF_DOC_STEPS = "## Next Steps\n\n"
HANDOFF_DOC_STEP = "{n}. {step}\n"
HANDOFF_DOC_FILES = "## Relevant Files\n\n"
HANDOFF_DOC_FILE_REASON = "- `{path}`: {reason}\n"
HANDOFF_DOC_FILE = "- `{path}`\n"
HANDOFF_DOC_SECTION_END = "\n"
HANDOFF_DOC_PROMPT = "## Copy-Ready Prompt\n\n```\n{prompt}\n```\n"

# Session summaries.
INGEST_SUMMARY = "Ingested {path}: {new} new, {updated} updated, {skipped} skipped"
OUTPUT_SUMMARY_FALLBACK = "coding output from {source}"
SPIT_SUMMARY = "spit: {goal} → {title}"
PLAN_SUMMARY = "{title}: {goal}"
EXPORT_SUMMARY = "export for project '{name}'"
FALLBACK_PLAN_TITLE = "Session Brief"
# ---------------------------------------------------------------------------

_FIELD = re.compile(r"\{(\w+)\}")


def _parts(template: str):
    pieces = _FIELD.split(template)
    return [(i % 2 == 1, p) for i, p in enumerate(pieces) if p or i % 2 == 1]


def render(template: str, **values) -> Column:
    """``template`` with each ``{field}`` replaced by the Column (or value)
    given for it."""
    cols = []
    for is_field, p in _parts(template):
        if is_field:
            v = values[p]
            cols.append(v if isinstance(v, Column) else F.lit(v))
        else:
            cols.append(F.lit(p))
    if not cols:
        return F.lit("")
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, **exprs: str) -> str:
    """The same rendering as a SQL ``||`` expression over SQL ``exprs``."""
    out = []
    for is_field, p in _parts(template):
        out.append(f"({exprs[p]})" if is_field else _sql_lit(p))
    return "(" + " || ".join(out) + ")" if out else "''"
