"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
TS = T.TimestampNTZType()
LIST = T.ArrayType(T.StringType(), containsNull=False)


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


PROJECTS = T.StructType([
    _f("id", S), _f("name", S), _f("root_path", S), _f("summary", S),
    _f("tags", LIST), _f("active_goals", LIST), _f("created_at", TS), _f("updated_at", TS),
])

DOCUMENTS = T.StructType([
    _f("id", S), _f("project_id", S), _f("path", S), _f("relative_path", S), _f("kind", S),
    _f("hash", S), _f("size", T.LongType()), _f("modified_at", TS), _f("summary", S),
    _f("raw_stored", T.BooleanType()), _f("created_at", TS),
])

CODING_OUTPUTS = T.StructType([
    _f("id", S), _f("project_id", S), _f("source", S), _f("raw_text", S), _f("goal", S),
    _f("actions", LIST), _f("files", LIST), _f("decisions", LIST), _f("blockers", LIST),
    _f("next_actions", LIST), _f("validation_notes", LIST), _f("commit_recommendations", LIST),
    _f("created_at", TS),
])

SESSION_ENTRIES = T.StructType([
    _f("id", S), _f("project_id", S), _f("type", S), _f("summary", S),
    _f("related_files", LIST), _f("decisions", LIST), _f("open_questions", LIST),
    _f("next_action", S), _f("created_at", TS),
])

PROJECT_SETTINGS = T.StructType([_f("key", S), _f("value", S), _f("updated_at", TS)])

HOOK_PAYLOAD = T.StructType([
    _f("session_id", S, True), _f("transcript_path", S, True),
    _f("cwd", S, True), _f("hook_event_name", S, True),
    _f("_corrupt_record", S, True),
])

# Session types.
SESSION_FOLDER_INGEST = "folder_ingest"
SESSION_FILE_INGEST = "file_ingest"
SESSION_OUTPUT_INGEST = "coding_output_ingest"
SESSION_SPIT = "spit"
SESSION_EXPORT = "export"
