"""DuckDB twins of the registered queries.

Each query is written independently of the Spark plan -- brute-force SQL
over the driver's pre-registered views (documents, conversations, events,
pages, benchmark) -- so the pair checks each other.  The adapter rules
mirror ``briefloom.sources.fixtures``; fixed value lists are shared.
"""

from __future__ import annotations

from briefloom.functions import levels as L
from briefloom.functions import paths as P
from briefloom.functions import text as TX
from briefloom.functions import formats as T
from briefloom.functions.formats import render_sql as R

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
GENERATED = "2024-06-01 12:00"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _pick(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {key} {arms} END)"


# ------------------------------------------------------------ expressions
def base(p):
    return f"regexp_extract({p}, '[^/]*$')"


def ext(p):
    return f"regexp_extract({base(p)}, '(\\.[^.]*)$', 1)"


def rel(path, root):
    prefix = f"(rtrim({root}, '/') || '/')"
    return (f"(CASE WHEN starts_with({path}, {prefix}) AND length({path}) > length({prefix}) "
            f"THEN substring({path}, length({prefix}) + 1) ELSE {base(path)} END)")


def dir_ok(relp):
    segs = f"string_split({relp}, '/')"
    dirs = f"list_slice({segs}, 1, len({segs}) - 1)"
    bad = (f"lambda d: lower(d) IN {_in([d.lower() for d in P.IGNORED_DIRS])} "
           f"OR (starts_with(d, '.') AND d <> '.')")
    return f"(len(list_filter({dirs}, {bad})) = 0)"


def file_ok(path, size):
    b = base(path)
    globs = " OR ".join(f"ends_with({b}, {_lit(p[1:])})" for p in P.IGNORED_PATTERNS if p.startswith("*"))
    lits = _in([p for p in P.IGNORED_PATTERNS if not p.startswith("*")])
    return (f"({size} <= {P.DEFAULT_MAX_SIZE_BYTES} AND lower({ext(path)}) NOT IN {_in(P.IGNORED_EXTS)} "
            f"AND NOT ({globs}) AND {b} NOT IN {lits})")


def kind(path):
    e, b = f"lower({ext(path)})", f"lower({base(path)})"
    suff = " OR ".join(f"ends_with({b}, {_lit(s)})" for s in P.CONFIG_SUFFIXES)
    return (f"(CASE WHEN {e} IN {_in(P.SOURCE_EXTS)} THEN 'source' "
            f"WHEN {e} IN {_in(P.MARKDOWN_EXTS)} THEN 'markdown' "
            f"WHEN {e} IN {_in(P.TEXT_EXTS)} THEN 'text' "
            f"WHEN {e} IN {_in(P.CONFIG_EXTS)} THEN 'config' "
            f"WHEN {b} IN {_in(P.CONFIG_BASENAMES)} THEN 'config' "
            f"WHEN {b} IN {_in(P.README_BASENAMES)} THEN 'markdown' "
            f"WHEN {suff} THEN 'config' ELSE 'other' END)")


def default_name(root):
    return f"lower(replace({base(f'rtrim({root}, {_lit(chr(47))})')}, ' ', '-'))"


def tokens(goal):
    stop = "[" + ", ".join(_lit(w) for w in TX.STOP_WORDS) + "]"
    return (f"list_filter(string_split_regex(lower({goal}), '[^\\p{{L}}\\p{{Nd}}]+'), "
            f"lambda t: strlen(t) > {TX.MIN_TOKEN_BYTES_EXCLUSIVE} AND NOT list_contains({stop}, t))")


def score(toks, relp, summary):
    return f"CAST(len(list_filter({toks}, lambda t: contains(lower({relp} || ' ' || {summary}), t))) AS BIGINT)"


WS = TX.WHITESPACE_CLASS


def trim_ws(s):
    return f"regexp_replace({s}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def fenced(s, fence):
    rest = f"substring({s}, instr({s}, {_lit(fence)}) + {len(fence)})"
    return (f"(CASE WHEN instr({s}, {_lit(fence)}) > 0 AND instr({rest}, '```') > 0 "
            f"THEN {trim_ws(f'substring({rest}, 1, instr({rest}, {_lit(chr(96) * 3)}) - 1)')} END)")


def json_block_ctes(src: str, raw: str, out: str) -> str:
    """CTEs turning column ``raw`` of ``src`` into ``block`` in ``out``."""
    fences = ", ".join(fenced("s0", f) for f in TX.JSON_FENCES)
    return f"""
{out}_a AS (SELECT *, {trim_ws(raw)} AS s0 FROM {src}),
{out}_b AS (SELECT *, coalesce({fences}, s0) AS s1 FROM {out}_a),
{out}_c AS (SELECT *, instr(s1, '{{') AS b_first,
                   length(s1) - length(regexp_extract(s1, '\\}}([^}}]*)$', 1)) AS b_last,
                   contains(s1, '}}') AS b_has FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN b_first > 0 AND b_has AND b_last > b_first
                         THEN substring(s1, b_first, b_last - b_first + 1) ELSE s1 END AS block FROM {out}_c),
{out} AS (SELECT *, CASE WHEN json_valid(block) THEN block ELSE '"not json"' END AS vj FROM {out}_d)"""


def str_ok(j, f):
    return f"coalesce(json_type({j}, '$.{f}'), 'NULL') IN ('VARCHAR', 'NULL')"


def list_ok(j, f):
    return (f"(coalesce(json_type({j}, '$.{f}'), 'NULL') = 'NULL' OR (json_type({j}, '$.{f}') = 'ARRAY' AND "
            f"len(list_filter(json_extract({j}, '$.{f}[*]'), lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0))")


def refs_ok(j, f):
    inner = ("json_type(r) = 'NULL' OR (json_type(r) = 'OBJECT' AND "
             "coalesce(json_type(r, '$.path'), 'NULL') IN ('VARCHAR', 'NULL') AND "
             "coalesce(json_type(r, '$.reason'), 'NULL') IN ('VARCHAR', 'NULL'))")
    return (f"(coalesce(json_type({j}, '$.{f}'), 'NULL') = 'NULL' OR (json_type({j}, '$.{f}') = 'ARRAY' AND "
            f"len(list_filter(json_extract({j}, '$.{f}[*]'), lambda r: NOT ({inner}))) = 0))")


def shape_ok(j, strs, lists, refs=()):
    parts = [f"json_type({j}) IN ('OBJECT', 'NULL')"]
    parts += [str_ok(j, f) for f in strs] + [list_ok(j, f) for f in lists] + [refs_ok(j, f) for f in refs]
    return "(" + " AND ".join(parts) + ")"


def jstr(j, f):
    return f"coalesce(json_extract_string({j}, '$.{f}'), '')"


def jlist(j, f):
    return (f"coalesce(list_transform(CAST(json_extract({j}, '$.{f}') AS VARCHAR[]), "
            f"lambda x: coalesce(x, '')), []::VARCHAR[])")


def joined(lst):
    return f"array_to_string({lst}, '|')"


def minutes(x):
    return f"({EPOCH} + INTERVAL ({x}) MINUTE)"


def seconds(x):
    return f"({EPOCH} + INTERVAL ({x}) SECOND)"


# ------------------------------------------------------------- fixtures
_BASES = ["'f' || {s} || '.go'", "'f' || {s} || '.py'", "'f' || {s} || '.md'", "'f' || {s} || '.txt'",
          "'f' || {s} || '.json'", "'f' || {s} || '.PNG'", "'f' || {s} || '.min.js'",
          "'m' || {s} || '/Makefile'", "'f' || {s} || '.GO'", "'p' || {s} || '/package-lock.json'",
          "'e' || {s} || '/.env.example'", "'r' || {s} || '/README'"]
_DIRS = ["src", "node_modules/pkg", ".git/objects", "Docs", ".vscode/x", "lib/Vendor"]

_CORPUS_DIRS = ["src", "Docs", "cmd/app", "internal/x", "pages", "lib"]


def _manifest(name, dirs, bases):
    return f"""{name} AS (
  SELECT doc_id, source AS project_id, '/w/' || source AS root,
         '/w/' || source || '/' || {_pick('doc_id % 6', [_lit(d) for d in dirs])} || '/' ||
           {_pick('doc_id % 12', [b.format(s=_v('doc_id')) for b in bases])} AS path,
         CASE WHEN doc_id % 101 = 50 THEN 3145728 + doc_id ELSE strlen(text) END AS size,
         {minutes('doc_id')} AS mtime, sha256(text) AS hash,
         CASE WHEN doc_id % 7 = 0 THEN sha256(text || '~') ELSE sha256(text) END AS prev_hash,
         doc_id % 97 = 96 AS is_symlink
  FROM documents)"""


def _scan(src, out):
    return f"""{out}0 AS (
  SELECT *, {rel('path', 'root')} AS relative_path FROM {src}
  WHERE NOT is_symlink AND {file_ok('path', 'size')}),
{out} AS (SELECT *, {kind('path')} AS kind FROM {out}0 WHERE {dir_ok('relative_path')})"""


FX = {}
FX["fx_manifest"] = _manifest("fx_manifest", _DIRS, _BASES)
FX["fx_corpus"] = _manifest("fx_corpus", _CORPUS_DIRS, [b.replace(".PNG", ".ts").replace(".min.js", ".css") for b in _BASES])
FX["fx_scan"] = _scan("fx_manifest", "fx_scan")
FX["fx_cscan"] = _scan("fx_corpus", "fx_cscan")
FX["fx_prev"] = """fx_prev AS (
  SELECT sha256(project_id || '|' || relative_path) AS id, project_id, path, relative_path, kind,
         prev_hash AS hash, size, mtime AS modified_at,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'summary of ' || relative_path END AS summary,
         doc_id % 3 = 0 AS raw_stored, TIMESTAMP '2023-12-01 00:00:00' AS created_at
  FROM fx_cscan WHERE doc_id % 11 <> 0)"""
FX["fx_curr"] = """fx_curr AS (
  SELECT * EXCLUDE (hash), CASE WHEN doc_id % 89 <> 5 THEN hash END AS hash FROM fx_cscan WHERE doc_id % 13 <> 0)"""
FX["fx_diff"] = """fx_diff AS (
  SELECT coalesce(c.project_id, p.project_id) AS project_id,
         coalesce(c.relative_path, p.relative_path) AS relative_path,
         CASE WHEN c.path IS NULL THEN 'missing' WHEN c.hash IS NULL THEN 'error' WHEN p.id IS NULL THEN 'new'
              WHEN p.hash = c.hash THEN 'skipped' ELSE 'updated' END AS status,
         coalesce(p.id, sha256(c.project_id || '|' || c.relative_path)) AS id,
         c.doc_id, c.root, c.path, c.kind, c.hash, c.size, p.id AS prev_id, p.kind AS prev_kind, p.hash AS prev_hash, p.size AS prev_size,
         p.summary AS prev_summary, p.raw_stored AS prev_raw_stored
  FROM fx_curr c FULL OUTER JOIN fx_prev p
    ON c.project_id = p.project_id AND c.relative_path = p.relative_path)"""
FX["fx_docs"] = f"""fx_docs AS (
  SELECT {_v('doc_id')} AS id, source AS project_id, lang || '/' || {_v('doc_id')} || '.md' AS relative_path,
         'markdown' AS kind, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS summary,
         {minutes('doc_id')} AS modified_at
  FROM documents)"""
FX["fx_outputs"] = f"""fx_outputs AS (
  SELECT {_v('conv_id')} || '-' || {_v('turn')} AS id, 'src' || {_v('conv_id % 20')} AS project_id,
         'agent/' || {_v('conv_id')} || '/' || {_v('turn')} || '.md' AS source, text AS raw_text,
         CASE WHEN turn % 3 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS goal,
         CASE WHEN turn % 4 = 1 THEN [split_part(text, chr(10), 1)] ELSE []::VARCHAR[] END AS actions,
         CASE WHEN conv_id % 3 = 0 THEN ['src/f' || {_v('conv_id')} || '.go', 'docs/n' || {_v('turn')} || '.md']
              ELSE []::VARCHAR[] END AS files,
         CASE WHEN turn % 4 = 3 THEN []::VARCHAR[] ELSE ['decided ' || {_v('conv_id')}] END AS decisions,
         CASE WHEN conv_id % 5 = 0 THEN ['waiting on review'] ELSE []::VARCHAR[] END AS blockers,
         string_split(text, chr(10)) AS next_actions,
         {minutes('conv_id * 16 + turn')} AS created_at
  FROM conversations WHERE role = 'assistant')"""
FX["fx_sessions"] = f"""fx_sessions AS (
  SELECT {_v('event_id')} AS id, 'src' || {_v('user_id % 20')} AS project_id,
         CASE event_type WHEN 'view' THEN 'spit' WHEN 'click' THEN 'coding_output_ingest'
              WHEN 'error' THEN 'file_ingest' WHEN 'purchase' THEN 'folder_ingest' WHEN 'signup' THEN 'export'
              ELSE 'manual' END AS type,
         event_type || ':' || props AS summary,
         CASE WHEN value < 50 THEN '' ELSE 'follow up ' || {_v('event_id')} END AS next_action,
         ts AS created_at
  FROM events)"""
FX["fx_projects"] = f"""fx_projects AS (
  SELECT source AS id, 'proj-' || source AS name, '/w/' || source AS root_path,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 4 = 0 THEN ''
              ELSE 'Corpus ' || source END AS summary,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 3 = 0 THEN []::VARCHAR[]
              ELSE ['ship ' || source, 'review ' || source] END AS active_goals,
         {minutes('min(doc_id)')} AS created_at, {minutes('min(doc_id)')} AS updated_at
  FROM documents GROUP BY source)"""
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
UPATH = "regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1)"
FX["fx_res_projects"] = f"""fx_roots AS (
  SELECT page_id, unnest(['/' || {HOST}, '/' || {HOST} || '/' || regexp_extract({UPATH}, '^/([^/]+)', 1)]) AS root_path
  FROM pages),
fx_res_projects AS (
  SELECT substring(sha256(root_path), 1, 16) AS id, {default_name('root_path')} AS name, root_path,
         {seconds('min(page_id)')} AS created_at
  FROM fx_roots GROUP BY root_path
  UNION ALL
  SELECT 'p-unrooted', 'unrooted', '', {seconds('min(page_id)')} FROM pages)"""
FX["fx_cwds"] = f"""fx_cwds AS (SELECT page_id AS cwd_id, rtrim('/' || {HOST} || {UPATH}, '/') AS cwd FROM pages)"""
FX["fx_settings"] = f"""fx_settings_log AS (
  SELECT 'active_project_id' AS key, substring(sha256('/' || {HOST}), 1, 16) AS value,
         {seconds('page_id')} AS updated_at FROM pages
  UNION ALL
  SELECT 'display', 'mode-' || {_v('page_id % 3')}, {seconds('page_id')} FROM pages WHERE page_id % 4 = 0),
fx_settings AS (SELECT key, arg_max(value, updated_at) AS value FROM fx_settings_log GROUP BY key)"""
FX["fx_detect"] = """fx_rootkeys AS (
  SELECT id, created_at, CASE WHEN ends_with(root_path, '/') THEN root_path ELSE root_path || '/' END AS rk
  FROM fx_res_projects WHERE root_path <> ''),
fx_match AS (
  SELECT c.cwd_id, r.id, row_number() OVER (PARTITION BY c.cwd_id ORDER BY length(r.rk) DESC, r.created_at, r.id) AS rn
  FROM fx_cwds c JOIN fx_rootkeys r ON starts_with(c.cwd || '/', r.rk)),
fx_detect AS (
  SELECT c.cwd_id, c.cwd,
         CASE WHEN (SELECT count(*) FROM fx_res_projects) = 1 THEN (SELECT min(id) FROM fx_res_projects)
              ELSE m.id END AS project_id
  FROM fx_cwds c LEFT JOIN fx_match m ON m.cwd_id = c.cwd_id AND m.rn = 1)"""
_LEVEL_CASE = _pick("item_id % 5", [_lit(x) for x in ["", "compact", "standard", "full", "bogus"]])
FX["fx_requests"] = f"""fx_requests0 AS (
  SELECT 'r' || {_v('item_id')} AS request_id, 'src' || {_v('item_id % 21')} AS project_id,
         text AS goal, {_LEVEL_CASE} AS level0,
         item_id % 7 = 0 AS compact_only, item_id % 7 = 1 AS full_flag,
         CASE WHEN item_id % 2 = 0 THEN '' ELSE 'model-b' END AS model_override
  FROM benchmark),
fx_requests1 AS (
  SELECT *, CASE WHEN level0 <> '' THEN level0 WHEN compact_only THEN 'compact'
                 WHEN full_flag THEN 'detailed' ELSE '' END AS requested FROM fx_requests0),
fx_requests AS (
  SELECT *, requested IN {_in(list(L.LEVEL_ALIASES))} AS is_valid,
         CASE requested WHEN 'compact' THEN 'compact' WHEN 'detailed' THEN 'detailed'
              WHEN 'full' THEN 'detailed' ELSE 'standard' END AS level
  FROM fx_requests1),
fx_valid_requests AS (
  SELECT *, CASE level WHEN 'compact' THEN 2 WHEN 'detailed' THEN 10 ELSE 5 END AS max_outputs,
         CASE level WHEN 'compact' THEN 2 WHEN 'detailed' THEN 8 ELSE 5 END AS max_sessions,
         CASE level WHEN 'compact' THEN 3 WHEN 'detailed' THEN 15 ELSE 8 END AS doc_limit
  FROM fx_requests WHERE is_valid)"""


def _x_body(c, t):
    return (f"'{{\"summary\": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ', \"goal\": \"finish task ' || {c} || "
            f"'\", \"actions\": [\"edit f' || {c} || '.go\", null], \"decisions\": [], \"blockers\": null' || "
            f"', \"next_actions\": [\"test ' || {c} || '\", \"ship ' || {t} || "
            f"'\"], \"files_mentioned\": [\"f' || {c} || '.go\"], \"extra\": {{\"k\": ' || {t} || '}}}}'")


_C, _T = _v("conv_id"), _v("turn")
_XB = _x_body(_C, _T)
_XCONTENT = _pick("(conv_id * 16 + turn) % 7", [
    _XB,
    f"'Here it is:' || chr(10) || '```json' || chr(10) || {_XB} || chr(10) || '```' || chr(10) || 'Done.'",
    f"'```JSON' || chr(10) || {_XB} || chr(10) || '```'",
    f"'Result: ' || {_XB} || ' -- end'",
    f"'{{\"summary\": \"x\", \"goal\": ' || {_T} || ', \"actions\": []}}'",
    f"{_XB} || chr(10) || {_XB}",
    f"'no structured output for turn ' || {_T}",
])
FX["fx_xresp"] = f"""fx_xresp0 AS (
  SELECT 'x' || {_C} || '-' || {_T} AS request_id, {_C} || '-' || {_T} AS output_id,
         CASE WHEN (conv_id * 16 + turn) % 11 = 10 THEN NULL ELSE {_XCONTENT} END AS content,
         CASE WHEN (conv_id * 16 + turn) % 11 = 10 THEN 'timeout' ELSE '' END AS error
  FROM conversations WHERE role = 'assistant'),{json_block_ctes('fx_xresp0', 'content', 'fx_xresp1')},
fx_xresp AS (
  SELECT request_id, output_id, content, block, vj,
         content IS NOT NULL AND error = '' AS answered,
         content IS NOT NULL AND error = '' AND {shape_ok('vj', ['summary', 'goal'], ['actions', 'decisions', 'blockers', 'next_actions', 'files_mentioned'])} AS ok
  FROM fx_xresp1),
fx_xresp2 AS (SELECT *, CASE WHEN ok THEN vj ELSE '{{}}' END AS jb FROM fx_xresp),
fx_extractions AS (
  SELECT request_id, output_id, ok,
         CASE WHEN ok THEN {jstr('jb', 'summary')} WHEN answered THEN content ELSE '' END AS summary,
         CASE WHEN ok THEN {jstr('jb', 'goal')} ELSE '' END AS goal,
         CASE WHEN ok THEN {jlist('jb', 'actions')} ELSE []::VARCHAR[] END AS actions,
         CASE WHEN ok THEN {jlist('jb', 'decisions')} ELSE []::VARCHAR[] END AS decisions,
         CASE WHEN ok THEN {jlist('jb', 'blockers')} ELSE []::VARCHAR[] END AS blockers,
         CASE WHEN ok THEN {jlist('jb', 'next_actions')} ELSE []::VARCHAR[] END AS next_actions,
         CASE WHEN ok THEN {jlist('jb', 'files_mentioned')} ELSE []::VARCHAR[] END AS files_mentioned
  FROM fx_xresp2)"""
FX["fx_normalized"] = """fx_normalized AS (
  SELECT o.id, o.project_id, o.source, o.created_at,
         CASE WHEN o.goal = '' THEN coalesce(e.goal, '') ELSE o.goal END AS goal,
         CASE WHEN len(o.actions) = 0 AND len(coalesce(e.actions, [])) > 0 THEN e.actions ELSE o.actions END AS actions,
         CASE WHEN len(o.decisions) = 0 AND len(coalesce(e.decisions, [])) > 0 THEN e.decisions ELSE o.decisions END AS decisions,
         CASE WHEN len(o.blockers) = 0 AND len(coalesce(e.blockers, [])) > 0 THEN e.blockers ELSE o.blockers END AS blockers,
         CASE WHEN len(o.next_actions) = 0 AND len(coalesce(e.next_actions, [])) > 0 THEN e.next_actions ELSE o.next_actions END AS next_actions,
         CASE WHEN len(o.files) = 0 AND len(coalesce(e.files_mentioned, [])) > 0 THEN e.files_mentioned ELSE o.files END AS files
  FROM fx_outputs o LEFT JOIN fx_extractions e ON e.output_id = o.id)"""

_E, _U = _v("event_id"), _v("user_id")
_PLAN = (f"'{{\"title\": \"Plan ' || {_E} || '\", \"goal\": \"fix ' || event_type || "
         f"'\", \"why_now\": \"\", \"current_context\": [\"user ' || {_U} || "
         f"'\"], \"relevant_files\": [{{\"path\": \"src/e' || {_E} || '.go\", \"reason\": \"hot\"}}, null, {{\"path\": \"docs/u' || "
         f"{_U} || '.md\"}}], \"execution_plan\": [\"step one ' || {_E} || "
         f"'\", \"step two\"], \"constraints\": null, \"validation\": [], \"expected_output\": \"ok\", \"copy_ready_prompt\": \"do ' || "
         f"{_E} || '\"}}'")
_PCONTENT = _pick("event_id % 6", [
    _PLAN,
    f"'```json' || chr(10) || {_PLAN} || chr(10) || '```'",
    f"'{{\"title\": \"Empty ' || {_E} || '\", \"goal\": \"\", \"copy_ready_prompt\": \"\"}}'",
    f"'{{\"title\": \"T' || {_E} || '\", \"copy_ready_prompt\": \"only prompt ' || {_E} || '\", \"execution_plan\": []}}'",
    f"'{{\"title\": \"W\", \"goal\": \"g\", \"execution_plan\": \"not a list ' || {_E} || '\"}}'",
    f"'Sorry, I cannot plan event ' || {_E}",
])
_PSTR = ["title", "goal", "why_now", "expected_output", "copy_ready_prompt"]
_PLIST = ["current_context", "execution_plan", "constraints", "validation"]
FX["fx_plans"] = f"""fx_presp0 AS (
  SELECT 'e' || {_E} AS request_id, 'src' || {_v('user_id % 20')} AS project_id,
         event_type || ' task for user ' || {_U} AS request_goal, {_PCONTENT} AS content, '' AS error
  FROM events),{json_block_ctes('fx_presp0', 'content', 'fx_presp1')},
fx_presp AS (
  SELECT *, {shape_ok('vj', _PSTR, _PLIST, ['relevant_files'])} AS decoded FROM fx_presp1),
fx_plans AS (
  SELECT request_id, project_id, request_goal, content,
         decoded AND NOT ({jstr('vj', 'goal')} = '' AND {jstr('vj', 'copy_ready_prompt')} = '') AS ok,
         CASE WHEN decoded THEN vj ELSE '{{}}' END AS jb FROM fx_presp),
fx_plan_fields AS (
  SELECT request_id, project_id, request_goal, ok,
         CASE WHEN ok THEN {jstr('jb', 'title')} ELSE {_lit(T.FALLBACK_PLAN_TITLE)} END AS title,
         CASE WHEN ok THEN {jstr('jb', 'goal')} ELSE request_goal END AS goal,
         CASE WHEN ok THEN {jstr('jb', 'copy_ready_prompt')} ELSE content END AS copy_ready_prompt,
         CASE WHEN ok THEN {jlist('jb', 'execution_plan')} ELSE []::VARCHAR[] END AS execution_plan,
         CASE WHEN ok THEN {jlist('jb', 'current_context')} ELSE []::VARCHAR[] END AS current_context,
         CASE WHEN ok THEN coalesce(list_transform(json_extract(jb, '$.relevant_files[*]'),
              lambda r: struct_pack(path := coalesce(json_extract_string(r, '$.path'), ''),
                                    reason := coalesce(json_extract_string(r, '$.reason'), ''))), [])
              ELSE [] END AS relevant_files
  FROM fx_plans)"""


def _inbox_ext():
    return _pick("user_id % 6", [_lit(e) for e in [".md", ".txt", ".json", ".log", ".MD", ".pdf"]])


FX["fx_inbox"] = f"""fx_inbox0 AS (
  SELECT event_id AS arrival_id,
         '/inbox/src' || {_v('user_id % 20')} || '/' || event_type || '-' || {_U} || {_inbox_ext()} AS path,
         CASE WHEN user_id % 9 = 0 THEN '' ELSE 'Agent run ' || event_type || ' for user ' || {_U} ||
              chr(10) || 'next: review ' || event_type END AS content,
         'src' || {_v('user_id % 20')} AS project_id
  FROM events),
fx_inbox AS (SELECT * FROM fx_inbox0 WHERE {ext('path')} IN {_in(P.INBOX_EXTS)})"""

DEPS = {
    "fx_scan": ["fx_manifest"], "fx_cscan": ["fx_corpus"], "fx_prev": ["fx_cscan"], "fx_curr": ["fx_cscan"],
    "fx_diff": ["fx_prev", "fx_curr"], "fx_detect": ["fx_res_projects", "fx_cwds"],
    "fx_normalized": ["fx_outputs", "fx_xresp"],
}


def _with(*names) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(FX[n] for n in order) + "\n"


# ---------------------------------------------------------------- queries
Q = {}
Q["manifest_scan"] = _with("fx_scan") + "SELECT project_id, path, relative_path, kind, size, hash FROM fx_scan"
Q["content_hash"] = "SELECT doc_id, sha256(text) AS hash FROM documents"
Q["kind_distribution"] = (_with("fx_manifest") +
                          f"SELECT {kind('path')} AS kind, count(*) AS n_files FROM fx_manifest GROUP BY 1")
Q["relative_paths"] = (_with("fx_manifest") +
                       f"SELECT path, {rel('path', 'root')} AS relative_path, {base('path')} AS base_name, "
                       f"{ext('path')} AS extension FROM fx_manifest")
Q["incremental_scan"] = _with("fx_manifest") + f"""
, marks AS (
  SELECT project_id AS folder, {minutes('CAST(floor(avg(doc_id)) AS BIGINT)')} AS hwm
  FROM fx_manifest WHERE CAST(regexp_extract(project_id, '(\\d+)$', 1) AS BIGINT) % 3 <> 0 GROUP BY project_id),
cand AS (
  SELECT f.project_id AS folder, f.path, f.mtime, m.hwm FROM fx_manifest f LEFT JOIN marks m ON m.folder = f.project_id
  WHERE (m.hwm IS NOT NULL AND f.mtime > m.hwm AND {ext('f.path')} IN ('.md', '.json', '.log'))
     OR (m.hwm IS NULL AND {ext('f.path')} IN ('.md', '.json'))),
with_mark AS (
  SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY mtime, path) AS ord FROM cand WHERE hwm IS NOT NULL),
no_mark AS (
  SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path DESC) AS ord FROM cand WHERE hwm IS NULL)
SELECT folder, path, ord FROM with_mark WHERE ord <= 5
UNION ALL SELECT folder, path, ord FROM no_mark WHERE ord = 1"""
Q["incremental_scan_next"] = _with("fx_corpus") + f"""
, f AS (SELECT project_id AS folder, path, {minutes('doc_id // 400')} AS mtime, {ext('path')} AS e,
               CAST(regexp_extract(project_id, '(\\d+)$', 1) AS BIGINT) % 3 <> 0 AS marked FROM fx_corpus),
first AS (SELECT * FROM f WHERE NOT marked AND e IN ('.md', '.json')
          QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path DESC) = 1),
todo AS (
  SELECT *, row_number() OVER (PARTITION BY folder ORDER BY mtime, path) AS n FROM f
  WHERE marked AND mtime > TIMESTAMP '2023-12-31 00:00:00' AND e IN ('.md', '.json', '.log')
  UNION ALL
  SELECT f.*, 5 + row_number() OVER (PARTITION BY f.folder ORDER BY f.mtime, f.path) AS n
  FROM f JOIN first g ON g.folder = f.folder
  WHERE (f.mtime, f.path) > (g.mtime, g.path) AND f.e IN ('.md', '.json', '.log')
  UNION ALL
  SELECT f.*, 5 + row_number() OVER (PARTITION BY f.folder ORDER BY f.path DESC) AS n
  FROM f WHERE NOT f.marked AND f.e IN ('.md', '.json') AND f.folder NOT IN (SELECT folder FROM first))
SELECT folder, path, n - 5 AS ord FROM todo WHERE n BETWEEN 6 AND 10"""
Q["ingest_diff"] = _with("fx_diff") + "SELECT project_id, relative_path, status, id FROM fx_diff"
Q["ingest_summary"] = _with("fx_diff") + """
SELECT project_id, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'updated') AS updated,
       count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors
FROM fx_diff WHERE status <> 'missing' GROUP BY project_id"""
Q["ingest_sessions"] = _with("fx_diff") + f"""
, c AS (
  SELECT project_id, count(*) FILTER (WHERE status = 'new') AS n_new, count(*) FILTER (WHERE status = 'updated') AS n_upd,
         count(*) FILTER (WHERE status = 'skipped') AS n_skip
  FROM fx_diff WHERE status <> 'missing' GROUP BY project_id),
roots AS (SELECT DISTINCT project_id, root FROM fx_corpus UNION ALL
          SELECT DISTINCT project_id, root || '-extra' FROM fx_corpus
          WHERE CAST(regexp_extract(project_id, '(\\d+)$', 1) AS BIGINT) % 4 = 0),
s AS (
  SELECT r.project_id, r.root, coalesce(n_new, 0) AS n_new, coalesce(n_upd, 0) AS n_upd, coalesce(n_skip, 0) AS n_skip
  FROM roots r LEFT JOIN c ON c.project_id = r.project_id AND NOT ends_with(r.root, '-extra'))
SELECT project_id, CASE WHEN n_new + n_upd = 1 THEN 'file_ingest' ELSE 'folder_ingest' END AS type,
       {R(T.INGEST_SUMMARY, path="root", new=_v('n_new'), updated=_v('n_upd'), skipped=_v('n_skip'))} AS summary,
       '' AS next_action
FROM s"""
Q["document_upsert"] = _with("fx_diff") + """
SELECT id, project_id, relative_path,
       CASE WHEN status IN ('new', 'updated') THEN kind ELSE prev_kind END AS kind,
       CASE WHEN status IN ('new', 'updated') THEN hash ELSE prev_hash END AS hash,
       CASE WHEN status IN ('new', 'updated') THEN size ELSE prev_size END AS size,
       coalesce(nullif(CASE WHEN doc_id % 3 = 1 THEN (SELECT split_part(text, chr(10), 1) FROM documents d
                                                      WHERE d.doc_id = fx_diff.doc_id) END, ''), prev_summary, '') AS summary,
       coalesce(prev_raw_stored, false) AS raw_stored
FROM fx_diff WHERE status <> 'error' OR prev_id IS NOT NULL"""
Q["settings_latest"] = _with("fx_settings") + "SELECT key, value FROM fx_settings"
Q["project_list"] = _with("fx_res_projects", "fx_settings") + """
SELECT p.id, p.name, p.root_path, coalesce(s.value IS NOT NULL, false) AS is_active
FROM fx_res_projects p LEFT JOIN fx_settings s ON s.key = 'active_project_id' AND s.value = p.id"""
Q["resolve_project"] = _with("fx_detect") + "SELECT cwd_id, cwd, project_id FROM fx_detect"
Q["resolve_project_modes"] = _with("fx_detect", "fx_settings") + """
, act AS (
  SELECT s.value AS active_id, p.id IS NOT NULL AS active_ok
  FROM fx_settings s LEFT JOIN fx_res_projects p ON p.id = s.value
  WHERE s.key = 'active_project_id' AND s.value <> ''),
base AS (SELECT d.*, a.active_id, coalesce(a.active_ok, false) AS active_ok FROM fx_detect d LEFT JOIN act a ON true)
SELECT cwd_id, 'active_first' AS mode,
       CASE WHEN active_ok THEN active_id WHEN active_id IS NOT NULL THEN NULL ELSE project_id END AS project_id,
       CASE WHEN active_ok THEN 'active' WHEN active_id IS NOT NULL THEN NULL
            WHEN project_id IS NOT NULL THEN 'detected' END AS resolved_by,
       CASE WHEN active_id IS NOT NULL AND NOT active_ok THEN 'active project not found'
            WHEN project_id IS NULL THEN 'no project found' ELSE '' END AS error
FROM base
UNION ALL
SELECT cwd_id, 'detect_first',
       CASE WHEN project_id IS NOT NULL THEN project_id WHEN active_ok THEN active_id END,
       CASE WHEN project_id IS NOT NULL THEN 'detected' WHEN active_ok THEN 'active' END,
       CASE WHEN project_id IS NULL AND NOT active_ok THEN 'no project found' ELSE '' END
FROM base"""
Q["project_lookup"] = _with("fx_res_projects") + f"""
, keys AS (
  SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN substring(sha256('/' || {HOST}), 1, 16)
                       WHEN page_id % 3 = 1 THEN {default_name(f"'/' || {HOST}")}
                       ELSE 'missing-' || {_v('page_id')} END AS key
  FROM pages),
by_name AS (SELECT name, arg_min(id, (created_at, id)) AS id FROM fx_res_projects GROUP BY name)
SELECT k.key, coalesce(i.id, n.id) AS project_id,
       CASE WHEN i.id IS NOT NULL THEN 'id' WHEN n.id IS NOT NULL THEN 'name' ELSE 'not_found' END AS matched_by
FROM keys k LEFT JOIN fx_res_projects i ON i.id = k.key LEFT JOIN by_name n ON n.name = k.key"""
Q["project_register"] = _with("fx_projects") + f"""
, cand AS (
  SELECT CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 19 = 0 THEN 'proj-src' || {_v('page_id % 20')}
              ELSE {default_name(f"'/srv/' || {HOST}")} END AS name,
         '/srv/' || {HOST} AS root_path, {seconds('page_id')} AS created_at
  FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at, root_path) AS n FROM cand),
st AS (
  SELECT r.name, r.root_path, r.created_at,
         CASE WHEN r.name = '' THEN 'name_required'
              WHEN r.name IN (SELECT name FROM fx_projects) OR r.n > 1 THEN 'duplicate_name'
              ELSE 'created' END AS status
  FROM ranked r)
SELECT CASE WHEN status = 'created' THEN sha256('project|' || name) END AS id, name, root_path, status, count(*) AS n_candidates
FROM st GROUP BY name, root_path, created_at, status"""
Q["project_update"] = _with("fx_projects") + """
, ch AS (
  SELECT 'src' || CAST(item_id % 25 AS VARCHAR) AS id, text AS summary, item_id FROM benchmark),
last AS (SELECT id, arg_max(summary, item_id) AS summary FROM ch GROUP BY id)
SELECT coalesce(p.id, l.id) AS id, CASE WHEN p.id IS NULL THEN NULL WHEN l.id IS NULL THEN p.name ELSE 'new-' || p.id END AS name,
       p.root_path, CASE WHEN p.id IS NOT NULL THEN coalesce(l.summary, p.summary) END AS summary,
       CASE WHEN p.id IS NULL THEN NULL WHEN l.id IS NULL THEN array_to_string(p.active_goals, '|') ELSE l.summary END AS goals,
       CASE WHEN p.id IS NULL THEN 'not_found' WHEN l.id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS status
FROM fx_projects p FULL OUTER JOIN last l ON l.id = p.id"""
Q["project_use"] = _with("fx_res_projects") + f"""
, k AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substring(sha256('/' || {HOST}), 1, 16)
                       WHEN page_id % 3 = 1 THEN {default_name(f"'/' || {HOST}")} ELSE 'missing' END AS key FROM pages),
n AS (SELECT name, arg_min(id, (created_at, id)) AS id FROM fx_res_projects GROUP BY name)
SELECT 'active_project_id' AS key, coalesce(i.id, n.id) AS value, {_v(seconds('page_id'))} AS updated_at
FROM k LEFT JOIN fx_res_projects i ON i.id = k.key LEFT JOIN n ON n.name = k.key
WHERE coalesce(i.id, n.id) IS NOT NULL"""
Q["project_delete"] = _with("fx_projects", "fx_docs", "fx_outputs", "fx_sessions") + """
, gone AS (SELECT id FROM fx_projects WHERE CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) % 5 = 0)
SELECT 'documents' AS table_name, id, project_id FROM fx_docs WHERE project_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'coding_outputs', id, project_id FROM fx_outputs WHERE project_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'session_entries', id, project_id FROM fx_sessions WHERE project_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'projects', id, id FROM fx_projects WHERE id NOT IN (SELECT id FROM gone)"""
Q["documents_by_project"] = _with("fx_docs") + "SELECT project_id, relative_path, id FROM fx_docs"


def _recent(src, time_col, n, extra=""):
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {time_col} DESC, id DESC) "
            f"AS recency_rank FROM {src} {extra}) WHERE recency_rank <= {n}")


Q["listing_cap100"] = _with("fx_outputs", "fx_sessions") + f"""
SELECT 'coding_outputs' AS table_name, project_id, id, recency_rank FROM ({_recent('fx_outputs', 'created_at', L.LISTING_CAP)})
UNION ALL
SELECT 'session_entries', project_id, id, recency_rank FROM ({_recent('fx_sessions', 'created_at', L.LISTING_CAP)})"""
Q["recent_outputs"] = (_with("fx_outputs") +
                       f"SELECT project_id, id, recency_rank FROM ({_recent('fx_outputs', 'created_at', 5)})")
Q["recent_sessions"] = (_with("fx_sessions") +
                        f"SELECT project_id, id, recency_rank FROM ({_recent('fx_sessions', 'created_at', 5)})")
Q["recent_doc_summaries"] = (_with("fx_docs") +
                             f"SELECT project_id, id, relative_path, recency_rank FROM "
                             f"({_recent('fx_docs', 'modified_at', 8, extra=chr(10) + 'WHERE summary <> ' + _lit(''))})")
Q["document_counts"] = _with("fx_docs") + "SELECT project_id, count(*) AS n_documents FROM fx_docs GROUP BY project_id"
Q["token_counts"] = f"SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens FROM documents"
Q["detail_levels"] = _with("fx_requests") + """
SELECT request_id, requested, level, is_valid,
       CAST(CASE level WHEN 'compact' THEN 2 WHEN 'detailed' THEN 10 ELSE 5 END AS BIGINT) AS max_outputs,
       CAST(CASE level WHEN 'compact' THEN 2 WHEN 'detailed' THEN 8 ELSE 5 END AS BIGINT) AS max_sessions,
       CAST(CASE level WHEN 'compact' THEN 3 WHEN 'detailed' THEN 15 ELSE 8 END AS BIGINT) AS max_docs
FROM fx_requests"""
FX["fx_ranked"] = f"""fx_recent_docs AS ({_recent('fx_docs', 'modified_at', L.MAX_CONTEXT_DOCS, extra="WHERE summary <> ''")}),
fx_scored AS (
  SELECT r.request_id, d.id AS doc_id, d.relative_path, d.summary, d.recency_rank,
         {score(tokens('r.goal'), 'd.relative_path', 'd.summary')} AS score
  FROM fx_valid_requests r JOIN fx_recent_docs d ON d.project_id = r.project_id AND d.recency_rank <= r.doc_limit),
fx_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, recency_rank) AS relevance_rank
  FROM fx_scored)"""
DEPS["fx_ranked"] = ["fx_docs", "fx_requests"]
Q["relevance_rank"] = (_with("fx_ranked") +
                       "SELECT request_id, doc_id, score, recency_rank, relevance_rank FROM fx_ranked")


def _bundle_ctes(no, ns, nd):
    return f"""fx_b_out AS (
  SELECT project_id, list(struct_pack(id := id, goal := goal, next_actions := next_actions, blockers := blockers,
                                      decisions := decisions, files := files) ORDER BY recency_rank) AS outputs
  FROM ({_recent('fx_outputs', 'created_at', no)}) GROUP BY project_id),
fx_b_ses AS (
  SELECT project_id, list(struct_pack(id := id, type := type, summary := summary, next_action := next_action)
                          ORDER BY recency_rank) AS sessions
  FROM ({_recent('fx_sessions', 'created_at', ns)}) GROUP BY project_id),
fx_b_doc AS (
  SELECT project_id, list(struct_pack(relative_path := relative_path, summary := summary, kind := kind)
                          ORDER BY recency_rank) AS docs
  FROM ({_recent('fx_docs', 'modified_at', nd, extra="WHERE summary <> ''")}) GROUP BY project_id),
fx_bundles AS (
  SELECT p.id AS project_id, p.name, p.root_path, p.summary, p.active_goals,
         coalesce(o.outputs, []) AS outputs, coalesce(s.sessions, []) AS sessions, coalesce(d.docs, []) AS docs
  FROM fx_projects p LEFT JOIN fx_b_out o ON o.project_id = p.id LEFT JOIN fx_b_ses s ON s.project_id = p.id
  LEFT JOIN fx_b_doc d ON d.project_id = p.id)"""


def _bundles_with(limits, *extra):
    return _with("fx_projects", "fx_outputs", "fx_sessions", "fx_docs", *extra) + ", " + _bundle_ctes(*limits) + "\n"


Q["recent_context"] = _bundles_with((5, 5, 8)) + """
SELECT project_id, array_to_string(list_transform(outputs, lambda o: o.id), '|') AS output_ids,
       array_to_string(list_transform(sessions, lambda s: s.id), '|') AS session_ids,
       array_to_string(list_transform(docs, lambda d: d.relative_path), '|') AS doc_paths
FROM fx_bundles"""
Q["project_status"] = _with("fx_projects", "fx_docs", "fx_sessions") + f"""
, cnt AS (SELECT project_id, count(*) AS n FROM fx_docs GROUP BY project_id),
rs AS (SELECT project_id, string_agg('[' || type || '] ' || summary, '|' ORDER BY recency_rank) AS recent_sessions
       FROM ({_recent('fx_sessions', 'created_at', 3)}) GROUP BY project_id)
SELECT p.id AS project_id, coalesce(c.n, 0) AS n_documents, coalesce(r.recent_sessions, '') AS recent_sessions
FROM fx_projects p LEFT JOIN cnt c ON c.project_id = p.id LEFT JOIN rs r ON r.project_id = p.id"""


def _lines(arr, lam):
    return f"array_to_string(list_transform({arr}, {lam}), '')"


def _sec(cond, text):
    return f"(CASE WHEN {cond} THEN {text} ELSE '' END)"


def _items(arr, template):
    return _lines(arr, f"lambda x: {R(template, item='x')}")


def _handoff_sql(limits, compact):
    full_view = "false" if compact else "true"
    ctx = ("list_concat(active_goals, list_transform(sessions, lambda s: "
           f"{R(T.HANDOFF_CONTEXT_SESSION, type='s.type', summary='s.summary')}))")
    steps = ("list_concat(list_filter(list_transform(sessions, lambda s: s.next_action), lambda a: a <> ''), "
             "flatten(list_transform(outputs, lambda o: o.next_actions)))")
    files = ("list_concat(flatten(list_transform(outputs, lambda o: list_transform(o.files, lambda f: "
             f"struct_pack(path := f, reason := {_lit(T.HANDOFF_FILE_REASON)})))), "
             "list_transform(docs, lambda d: struct_pack(path := d.relative_path, reason := d.summary)))")
    nexts = "flatten(list_transform(outputs, lambda o: o.next_actions))"
    prompt = " || ".join([
        R(T.HANDOFF_PROMPT_PROJECT, name="name"),
        _sec("summary <> ''", R(T.HANDOFF_PROMPT_DESCRIPTION, summary="summary")),
        _sec("len(active_goals) > 0", f"{_lit(T.HANDOFF_PROMPT_GOALS)} || " + _items("active_goals", T.HANDOFF_PROMPT_ITEM)),
        _sec("len(sessions) > 0", f"{_lit(T.HANDOFF_PROMPT_PROGRESS)} || " +
             _items("list_transform(sessions, lambda s: s.summary)", T.HANDOFF_PROMPT_ITEM)),
        _sec(f"len({nexts}) > 0", f"{_lit(T.HANDOFF_PROMPT_NEXT)} || " + _items(nexts, T.HANDOFF_PROMPT_ITEM)),
        _sec(f"{full_view} AND len(docs) > 0", f"{_lit(T.HANDOFF_PROMPT_FILES)} || " +
             _lines("docs", f"lambda d: {R(T.HANDOFF_PROMPT_FILE, path='d.relative_path', summary='d.summary')}")),
    ])
    end = _lit(T.HANDOFF_DOC_SECTION_END)
    doc = " || ".join([
        R(T.HANDOFF_DOC_HEAD, title=R(T.HANDOFF_TITLE, name="name"), generated=_lit(GENERATED)),
        R(T.HANDOFF_DOC_PROJECT, name="name"),
        _sec("summary <> ''", R(T.HANDOFF_DOC_SUMMARY, summary="summary")),
        _sec("len(ctx) > 0", f"{_lit(T.HANDOFF_DOC_CONTEXT)} || " + _items("ctx", T.HANDOFF_DOC_ITEM) + f" || {end}"),
        _sec("len(steps) > 0", f"{_lit(T.HANDOFF_DOC_STEPS)} || " +
             f"array_to_string(list_transform(steps, lambda s, i: {R(T.HANDOFF_DOC_STEP, n='CAST(i AS VARCHAR)', step='s')}), '')"
             + f" || {end}"),
        _sec(f"{full_view} AND len(files) > 0", f"{_lit(T.HANDOFF_DOC_FILES)} || " +
             _lines("files", f"lambda f: CASE WHEN f.reason <> '' THEN "
                             f"{R(T.HANDOFF_DOC_FILE_REASON, path='f.path', reason='f.reason')} "
                             f"ELSE {R(T.HANDOFF_DOC_FILE, path='f.path')} END") + f" || {end}"),
        R(T.HANDOFF_DOC_PROMPT, prompt="prompt"),
    ])
    return _bundles_with(limits) + f"""
, h0 AS (SELECT *, {ctx} AS ctx, {steps} AS steps, {files} AS files FROM fx_bundles),
h1 AS (SELECT *, {prompt} AS prompt FROM h0),
h AS (SELECT *, {doc} AS document FROM h1)
"""


Q["handoff_export"] = _handoff_sql((5, 5, 10), False) + \
    f"SELECT project_id, {R(T.HANDOFF_TITLE, name='name')} AS title, document FROM h"
Q["handoff_steps"] = _handoff_sql((10, 10, 20), False) + \
    "SELECT project_id, CAST(len(steps) AS BIGINT) AS n_steps, array_to_string(steps, '|') AS steps, " \
    "array_to_string(ctx, '|') AS context FROM h"
Q["handoff_files"] = _handoff_sql((2, 2, 5), True) + \
    "SELECT project_id, CAST(len(files) AS BIGINT) AS n_files, " \
    "array_to_string(list_transform(files, lambda f: f.path || '=' || f.reason), '|') AS files, document FROM h"


def _brief_prompt():
    end = _lit(T.BRIEF_SECTION_END)
    project = " || ".join([
        R(T.BRIEF_PROJECT, name="name"),
        _sec("root_path <> ''", R(T.BRIEF_ROOT, root="root_path")),
        _sec("summary <> ''", R(T.BRIEF_DESCRIPTION, summary="summary")),
        _sec("len(active_goals) > 0", f"{_lit(T.BRIEF_GOALS)} || " + _items("active_goals", T.BRIEF_GOAL_ITEM)),
        end,
    ])
    history = _sec("len(ses) > 0", f"{_lit(T.BRIEF_HISTORY)} || " + _lines(
        "ses", f"lambda s: {R(T.BRIEF_SESSION, type='s.type', summary='s.summary')} || "
               f"(CASE WHEN s.next_action <> '' THEN {R(T.BRIEF_SESSION_NEXT, next_action='s.next_action')} "
               f"ELSE '' END)") + f" || {end}")

    def listed(arr, header):
        return _sec(f"len({arr}) > 0", f"{_lit(header)} || " + _items(arr, T.BRIEF_OUTPUT_ITEM))

    outs = _sec("len(outs) > 0", f"{_lit(T.BRIEF_OUTPUTS)} || " + _lines(
        "outs", "lambda o: " + " || ".join([
            _sec("o.goal <> ''", R(T.BRIEF_OUTPUT_GOAL, goal="o.goal")),
            listed("o.next_actions", T.BRIEF_OUTPUT_NEXT),
            listed("o.blockers", T.BRIEF_OUTPUT_BLOCKERS),
            listed("o.decisions", T.BRIEF_OUTPUT_DECISIONS),
        ])) + f" || {end}")
    files = _sec("len(rdocs) > 0", f"{_lit(T.BRIEF_FILES)} || " + _lines(
        "rdocs", f"lambda d: {R(T.BRIEF_FILE, path='d.relative_path', summary='d.summary')}") + f" || {end}")
    return f"{project} || {history} || {outs} || {files} || {R(T.BRIEF_REQUEST, goal='goal')}"


Q["plan_requests"] = _bundles_with((10, 8, 0), "fx_ranked") + f"""
, rd AS (SELECT request_id, list(struct_pack(relative_path := relative_path, summary := summary)
                                 ORDER BY relevance_rank) AS rdocs FROM fx_ranked GROUP BY request_id),
j AS (
  SELECT r.request_id, r.project_id, r.level, r.goal,
         CASE WHEN r.model_override = '' THEN 'default' ELSE r.model_override END AS model,
         b.name, b.root_path, b.summary, b.active_goals,
         list_slice(b.sessions, 1, r.max_sessions) AS ses, list_slice(b.outputs, 1, r.max_outputs) AS outs,
         coalesce(rd.rdocs, []) AS rdocs
  FROM fx_valid_requests r JOIN fx_bundles b ON b.project_id = r.project_id
  LEFT JOIN rd ON rd.request_id = r.request_id)
SELECT request_id, project_id, level, model, {_brief_prompt()} AS user_prompt FROM j"""
Q["extract_json"] = _with("fx_xresp") + "SELECT request_id, block AS json_block FROM fx_xresp"
Q["parse_extractions"] = _with("fx_xresp") + """
SELECT request_id, ok, summary, goal, array_to_string(actions, '|') AS actions,
       array_to_string(decisions, '|') AS decisions, array_to_string(blockers, '|') AS blockers,
       array_to_string(next_actions, '|') AS next_actions, array_to_string(files_mentioned, '|') AS files_mentioned
FROM fx_extractions"""
Q["normalize_outputs"] = _with("fx_normalized") + """
SELECT id, goal, array_to_string(actions, '|') AS actions, array_to_string(decisions, '|') AS decisions,
       array_to_string(blockers, '|') AS blockers, array_to_string(next_actions, '|') AS next_actions,
       array_to_string(files, '|') AS files
FROM fx_normalized"""
Q["sessions_from_outputs"] = _with("fx_normalized") + f"""
SELECT sha256('session|' || id) AS id, project_id,
       coalesce(nullif(goal, ''), nullif(actions[1], ''), {R(T.OUTPUT_SUMMARY_FALLBACK, source='source')}) AS summary,
       coalesce(next_actions[1], '') AS next_action, array_to_string(files, '|') AS related_files,
       array_to_string(blockers, '|') AS open_questions
FROM fx_normalized"""
Q["parse_plans"] = _with("fx_plans") + """
SELECT request_id, ok, title, goal, copy_ready_prompt, array_to_string(execution_plan, '|') AS execution_plan,
       array_to_string(current_context, '|') AS current_context,
       array_to_string(list_transform(relevant_files, lambda r: r.path || '=' || r.reason), '|') AS relevant_files
FROM fx_plan_fields"""
Q["plan_sessions"] = _with("fx_plans") + f"""
SELECT sha256('spit|' || request_id || '|1') AS id, request_id, {R(T.SPIT_SUMMARY, goal='request_goal', title='title')} AS summary,
       '' AS next_action, '' AS related_files
FROM fx_plan_fields
UNION ALL
SELECT sha256('spit|' || request_id || '|2'), request_id, {R(T.PLAN_SUMMARY, title='title', goal='goal')},
       coalesce(execution_plan[1], ''), array_to_string(list_transform(relevant_files, lambda r: r.path), '|')
FROM fx_plan_fields"""
_SID = "sha256('session|batch-1|' || project_id || '|' || type || '|' || summary)"
Q["session_append"] = f"""
SELECT {_SID} AS id, project_id, type, summary, '' AS related_files, '' AS open_questions, next_action,
       '2024-06-01 12:00:00' AS created_at
FROM ({Q["ingest_sessions"]})
UNION ALL
SELECT {_SID}, project_id, type, summary, '', '', '', '2024-06-01 12:00:00'
FROM (SELECT DISTINCT source AS project_id, 'export' AS type, {R(T.EXPORT_SUMMARY, name="'proj-' || source")} AS summary FROM documents)
UNION ALL
SELECT p.id, 'src' || {_v('e.user_id % 20')}, 'spit', p.summary, p.related_files, '', p.next_action, '2024-06-01 12:00:00'
FROM ({Q["plan_sessions"]}) p JOIN events e ON p.request_id = 'e' || {_v('e.event_id')}"""
Q["noop_plans"] = _with("fx_requests") + f"""
SELECT request_id, {_lit(T.FALLBACK_PLAN_TITLE)} AS title, goal, goal AS copy_ready_prompt, CAST(0 AS BIGINT) AS n_steps
FROM fx_valid_requests"""
Q["json_lists"] = _with("fx_outputs") + """
SELECT id, CAST(len(next_actions) AS BIGINT) AS n_items, true AS roundtrip_ok,
       CAST(CASE WHEN json_valid('[' || goal) THEN len(CAST(json('[' || goal) AS VARCHAR[])) ELSE 0 END AS BIGINT)
         AS n_malformed_items
FROM fx_outputs"""
_HSTR = ["session_id", "transcript_path", "cwd", "hook_event_name"]
Q["hook_payloads"] = _with("fx_projects") + f"""
, p0 AS (
  SELECT conv_id, turn,
         CASE WHEN turn % 5 = 4 THEN '' ELSE '/t/' || {_C} || '/' || {_T} || '.jsonl' END AS tpath,
         '{{"session_id": "s' || {_C} || '-' || {_T} || '", "transcript_path": "' ||
           (CASE WHEN turn % 5 = 4 THEN '' ELSE '/t/' || {_C} || '/' || {_T} || '.jsonl' END) ||
           '"' || {_pick('conv_id % 11', ["', " + '"cwd": ' + "'||place"] * 2 + ["''", "', " + '"cwd": null' + "'", "', " + '"CWD": ' + "'||place", "', " + '"cwd": "/nowhere", "cwd": ' + "'||place"] + ["', " + '"cwd": ' + "'||place"] * 5)} ||
           ', "hook_event_name": "Stop"}}' AS body,
         CASE WHEN conv_id % 11 IN (2, 3) THEN '' ELSE '/w/src' || {_v('conv_id % 20')} || '/sub' END AS real_cwd
  FROM (SELECT *, '"/w/src' || {_v('conv_id % 20')} || '/sub"' AS place FROM conversations)),
p1 AS (
  SELECT conv_id, turn, real_cwd,
         CASE WHEN (conv_id + turn) % 7 = 0 THEN substring(body, 1, 20)
              WHEN (conv_id + turn) % 7 = 1 THEN '{{"session_id": ' || {_C} || ', "transcript_path": "' || tpath || '"}}'
              ELSE body END AS payload
  FROM p0),
p2 AS (SELECT *, CASE WHEN json_valid(payload) THEN payload ELSE '"not json"' END AS vj FROM p1),
payloads AS (
  SELECT conv_id, turn, {jstr('vj', 'session_id')} AS session_id, {jstr('vj', 'transcript_path')} AS transcript_path,
         real_cwd AS cwd
  FROM p2 WHERE {shape_ok('vj', _HSTR, [])}),
tr AS (SELECT '/t/' || {_C} || '/' || {_T} || '.jsonl' AS transcript_path, text FROM conversations),
roots AS (SELECT id, created_at, root_path || '/' AS rk FROM fx_projects WHERE root_path <> ''),
m AS (
  SELECT p.session_id, p.transcript_path, coalesce(r.id, (SELECT max(id) FROM fx_projects)) AS project_id,
         row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY length(r.rk) DESC, r.created_at, r.id) AS rn
  FROM payloads p LEFT JOIN roots r ON starts_with(p.cwd || '/', r.rk)
  WHERE p.transcript_path <> '')
SELECT m.session_id, m.transcript_path, m.project_id, CAST(length(tr.text) AS BIGINT) AS n_chars
FROM m JOIN tr ON tr.transcript_path = m.transcript_path WHERE m.rn = 1"""
_HID = "sha256(h.project_id || '|' || h.transcript_path || '|' || sha256(c.text) || '|batch-1')"
Q["hook_outputs"] = f"""
SELECT {_HID} AS id, h.project_id, h.transcript_path AS source, 'x' || {_HID} AS request_id, h.n_chars,
       {R(T.OUTPUT_SUMMARY_FALLBACK, source='h.transcript_path')} AS summary
FROM ({Q["hook_payloads"]}) h
JOIN conversations c ON h.transcript_path = '/t/' || {_v('c.conv_id')} || '/' || {_v('c.turn')} || '.jsonl'"""
Q["inbox_stream"] = _with("fx_inbox") + "SELECT arrival_id, path, project_id FROM fx_inbox"
Q["inbox_dedup"] = _with("fx_inbox") + \
    "SELECT DISTINCT path, project_id, CAST(strlen(content) AS BIGINT) AS n_bytes FROM fx_inbox"
Q["inbox_sessions"] = _with("fx_inbox") + f"""
SELECT DISTINCT project_id, path AS source, {R(T.OUTPUT_SUMMARY_FALLBACK, source='path')} AS summary, '' AS next_action
FROM fx_inbox"""
Q["inbox_rejects"] = _with("fx_inbox") + f"""
SELECT arrival_id, path, 'unsupported_extension' AS reason FROM fx_inbox0
WHERE {ext('path')} NOT IN {_in(P.INBOX_EXTS)}"""

_NAME = "'t' || " + _v("conv_id") + " || '-' || " + _v("turn")
_EXT = _pick("(conv_id + turn) % 6", [_lit(e) for e in [".md", ".txt", ".json", ".log", ".MD", ".pdf"]])
_DROPPED = f"""
WITH f AS (SELECT {_NAME} AS stem, {_EXT} AS ext, CASE WHEN conv_id % 9 = 0 THEN '' ELSE coalesce(text, '') END AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""
Q["inbox_watch"] = _DROPPED + f"""
SELECT 'src1' AS project_id, stem || ext AS name, strlen(text)::BIGINT AS n_bytes, sha256(text) AS hash, length(text)::BIGINT AS asked,
       stem || '-0' || ext AS archived, true AS moved
FROM f WHERE ext IN {_in(P.INBOX_EXTS)}"""
Q["inbox_dead_letters"] = _DROPPED + f"""
SELECT stem || ext AS name, 'unsupported_extension' AS reason FROM f WHERE ext NOT IN {_in(P.INBOX_EXTS)}"""
FX["fx_files"] = """fx_files AS (
  SELECT m.* EXCLUDE (root, size, hash), '/w' AS root, strlen(coalesce(d.text, '')) AS size, sha256(coalesce(d.text, '')) AS hash
  FROM fx_manifest m JOIN documents d USING (doc_id) WHERE m.path IS NOT NULL)"""
FX["fx_fscan"] = _scan("fx_files", "fx_fscan")
DEPS |= {"fx_files": ["fx_manifest"], "fx_fscan": ["fx_files"]}
Q["live_tree_scan"] = _with("fx_fscan") + "SELECT relative_path, kind, size, hash FROM fx_fscan"

Q["ingest_diff_folders"] = Q["ingest_diff"]
Q["incremental_export"] = Q["incremental_scan_next"]
Q["recent_context_summaries"] = Q["recent_context"]
Q["relevance_rank_tokens"] = Q["relevance_rank"]
Q["project_listing"] = f"SELECT * FROM ({Q['listing_cap100']}) WHERE project_id = 'src1'"

ORACLE_SQL = Q
