"""Agent hook payloads -> transcript texts -> projects.

A payload is a JSON object naming the agent's transcript file and working
directory.  Unparsable payloads and payloads without a transcript path are
skipped; the transcript text is joined on its path; the project is resolved
from the cwd (detection first, then the active project).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.operators.resolve import resolve_projects
from briefloom.functions.json_strict import strict_hook_payload


def parse_payloads(payloads: DataFrame, text_col: str = "payload") -> DataFrame:
    """(session_id, transcript_path, cwd, hook_event_name) of payloads that
    decode strictly (an object, string-typed known keys, no trailing text);
    anything else is skipped."""
    p = strict_hook_payload(F.col(text_col))
    return payloads.select(p.alias("p")).where(F.col("p").isNotNull()).select("p.*")


def hook_texts(payloads: DataFrame, transcripts: DataFrame, projects: DataFrame, settings: DataFrame) -> DataFrame:
    """(session_id, project_id, source, raw_text): each payload's transcript
    and resolved project.

    ``transcripts``: (transcript_path, transcript).  Payloads whose project
    cannot be resolved are dropped, like the reference's silent skip.
    """
    ok = parse_payloads(payloads).where(F.col("transcript_path") != "")
    # A payload without a cwd decodes to "", which no root holds: the active
    # project decides, as for any cwd that is not found.
    cwds = ok.select(F.col("cwd").alias("cwd_id"), "cwd").distinct()
    resolved = resolve_projects(cwds, projects, settings, mode="detect_first").select("cwd", "project_id")
    return (ok.join(transcripts, "transcript_path").join(resolved, "cwd", "left")
            .where(F.col("project_id").isNotNull())
            .select("session_id", "project_id", F.col("transcript_path").alias("source"), F.col("transcript").alias("raw_text")))


def ingest_hook_payloads(payloads: DataFrame, transcripts: DataFrame, projects: DataFrame,
                         settings: DataFrame) -> DataFrame:
    """(session_id, transcript_path, project_id, n_chars) of ``hook_texts``."""
    return hook_texts(payloads, transcripts, projects, settings).select(
        "session_id", F.col("source").alias("transcript_path"), "project_id",
        F.length("raw_text").cast("bigint").alias("n_chars"))
