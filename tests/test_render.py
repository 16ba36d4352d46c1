"""Golden text for the handoff document and the brief request."""

from pyspark.sql import functions as F

from briefloom.operators import context as C
from briefloom.operators import render as R

PROJECTS = [("p1", "alpha", "/w/alpha", "Alpha app", ["ship v1"], "2024-01-01 00:00:00")]
OUTPUTS = [("o1", "p1", "fix auth", ["write tests"], [], ["use jwt"], ["auth.go"], "2024-01-02 00:00:00"),
           ("o2", "p1", "", ["deploy"], ["ci red"], [], [], "2024-01-03 00:00:00")]
SESSIONS = [("s1", "p1", "spit", "planned auth", "start auth", "2024-01-02 00:00:00"),
            ("s2", "p1", "file_ingest", "Ingested x", "", "2024-01-04 00:00:00")]
DOCS = [("d1", "p1", "src/auth.go", "auth handlers", "source", "2024-01-01 00:00:00"),
        ("d2", "p1", "README.md", "", "markdown", "2024-01-05 00:00:00")]


def _tables(spark):
    ts = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    p = ts(spark.createDataFrame(PROJECTS, "id string, name string, root_path string, summary string, "
                                            "active_goals array<string>, created_at string"), "created_at")
    o = ts(spark.createDataFrame(OUTPUTS, "id string, project_id string, goal string, next_actions array<string>, "
                                           "blockers array<string>, decisions array<string>, files array<string>, "
                                           "created_at string"), "created_at")
    s = ts(spark.createDataFrame(SESSIONS, "id string, project_id string, type string, summary string, "
                                            "next_action string, created_at string"), "created_at")
    d = ts(spark.createDataFrame(DOCS, "id string, project_id string, relative_path string, summary string, "
                                        "kind string, modified_at string"), "modified_at")
    return p, o, s, d


HANDOFF = """# Handoff: alpha

Generated: 2024-06-01 12:00

## Project: alpha

Alpha app

## Current Context

- ship v1
- [file_ingest] Ingested x
- [spit] planned auth

## Next Steps

1. start auth
2. deploy
3. write tests

## Relevant Files

- `auth.go`: mentioned in recent coding output
- `src/auth.go`: auth handlers

## Copy-Ready Prompt

```
Project: alpha
Description: Alpha app
Goals:
  - ship v1

Recent progress:
  - Ingested x
  - planned auth

Suggested next actions:
  - deploy
  - write tests

Key files:
  - src/auth.go: auth handlers

```
"""


def test_handoff_golden(spark):
    b = C.context_bundles(*_tables(spark), 5, 5, 10)
    doc = R.handoff_documents(b, "2024-06-01 12:00").first().document
    assert doc == HANDOFF


def test_handoff_compact_omits_files(spark):
    b = C.context_bundles(*_tables(spark), 2, 2, 5)
    doc = R.handoff_documents(b, "2024-06-01 12:00", compact=True).first().document
    assert "## Relevant Files" not in doc and "Key files:" not in doc


BRIEF = """PROJECT: alpha
ROOT: /w/alpha
DESCRIPTION: Alpha app
ACTIVE GOALS:
  - ship v1

RECENT SESSION HISTORY:
  [file_ingest] Ingested x
  [spit] planned auth
    → next: start auth

RECENT CODING AGENT OUTPUTS:
  Next actions:
    - deploy
  Blockers:
    - ci red
  Goal: fix auth
  Next actions:
    - write tests
  Decisions:
    - use jwt

RELEVANT PROJECT FILES:
  [src/auth.go] auth handlers

DEVELOPER REQUEST: fix the auth flow
"""


def test_brief_request_golden(spark):
    p, o, s, d = _tables(spark)
    req = spark.createDataFrame([("r1", "p1", "fix the auth flow", "standard", "", 8)],
                                "request_id string, project_id string, goal string, level string, "
                                "model_override string, doc_limit int")
    bundles = C.context_bundles(p, o, s, d, 10, 8, 0)
    ranked = C.rank_documents(req, d)
    out = R.brief_requests(req, bundles, ranked, system_prompt="sys").first()
    assert out.messages[1].content == BRIEF
    assert "fix the auth flow" in out.messages[1].content and "alpha" in out.messages[1].content
    assert out.model == "default" and out.max_tokens == 4096
