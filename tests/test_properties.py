"""Property tests: the Spark expressions against their independent DuckDB
formulations on generated adversarial strings."""

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from briefloom.functions.text import extract_json_block, tokenize
from briefloom.plans import oracle as O

PIECES = ["```json", "```JSON", "```", "{", "}", '{"a": 1}', " ", "\n", "\t", " ", "　", "x", "é",
          "json", "[", "]", "\"", "ab", "The", "and", "é1", "AUTH", "go", "123", "-", "ß", "İ", "ΟΔΟΣ", "Σ", "ǅ"]
texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=14).map("".join)
batches = st.lists(texts, min_size=1, max_size=25)


def _duck_blocks(values):
    con = duckdb.connect()
    con.register("src0", pd.DataFrame({"i": range(len(values)), "raw": values}))
    sql = "WITH " + O.json_block_ctes("src0", "raw", "out").strip() + " SELECT i, block FROM out ORDER BY i"
    return [r[1] for r in con.sql(sql).fetchall()]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches)
def test_json_block_matches_sql_twin(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    got = [r[1] for r in df.select("i", extract_json_block("raw")).orderBy("i").collect()]
    assert got == _duck_blocks(values)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches)
def test_tokenizer_matches_sql_twin(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, g string")
    got = [list(r[1]) for r in df.select("i", tokenize("g")).orderBy("i").collect()]
    con = duckdb.connect()
    con.register("g0", pd.DataFrame({"i": range(len(values)), "g": values}))
    want = [list(r[1]) for r in con.sql(f"SELECT i, {O.tokens('g')} FROM g0 ORDER BY i").fetchall()]
    assert got == want


SEGMENTS = ["src", "Docs", ".git", "node_modules", "VENDOR", "diſt", "dİst", ".", "..", ".hidden", "_x",
            "tmp", "outer", "out", "a b", "é"]
BASES = ["main.go", "MAIN.GO", "x.min.js", "x.MIN.JS", "go.sum", "Go.sum", "README", "readme.txt", ".env",
         "a.env.example", "Makefile", "x.", "noext", "pic.PNG", "a.pb.go", "x.İNİ", "ſ.md"]
paths = st.tuples(st.lists(st.sampled_from(SEGMENTS), max_size=4), st.sampled_from(BASES),
                  st.integers(min_value=0, max_value=3 << 20))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(paths, min_size=1, max_size=30))
def test_path_rules_match_sql_twin(spark, items):
    from pyspark.sql import functions as F

    from briefloom.functions import paths as P
    rows = [(i, "/r/" + "/".join(segs + [b]), s) for i, (segs, b, s) in enumerate(items)]
    df = spark.createDataFrame(rows, "i int, path string, size bigint").withColumn("root", F.lit("/r"))
    rel = P.relative_path("path", "root")
    got = [tuple(r)[1:] for r in df.select(
        "i", rel.alias("rel"), P.file_kind("path").alias("kind"),
        P.passes_file_filter("path", "size").alias("f_ok"), P.passes_dir_filter(rel).alias("d_ok"),
        P.default_project_name("path").alias("name")).orderBy("i").collect()]
    con = duckdb.connect()
    con.register("p0", pd.DataFrame({"i": [r[0] for r in rows], "path": [r[1] for r in rows],
                                     "size": [r[2] for r in rows], "root": "/r"}))
    sql = (f"SELECT i, {O.rel('path', 'root')}, {O.kind('path')}, {O.file_ok('path', 'size')}, "
           f"{O.dir_ok(O.rel('path', 'root'))}, {O.default_name('path')} FROM p0 ORDER BY i")
    want = [tuple(r)[1:] for r in con.sql(sql).fetchall()]
    assert got == want


_values = st.one_of(st.just(None), st.text(alphabet="ab é\"\\", max_size=4), st.integers(-5, 5),
                    st.lists(st.one_of(st.just(None), st.text(alphabet="xy", max_size=3)), max_size=3),
                    st.lists(st.integers(0, 3), min_size=1, max_size=2))
_keys = st.sampled_from(["summary", "goal", "actions", "decisions", "blockers", "next_actions",
                         "files_mentioned", "extra"])
_objects = st.dictionaries(_keys, _values, max_size=5)
_answers = st.tuples(_objects, st.sampled_from(["", " ", "\n", " tail", "{}", "]"])).map(
    lambda t: __import__("json").dumps(t[0]) + t[1]) | st.sampled_from(["null", "[]", "3", '"s"', ""])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_answers, min_size=1, max_size=30))
def test_strict_extraction_matches_sql_twin(spark, answers):
    from pyspark.sql import functions as F

    from briefloom.functions.json_strict import strict_extraction
    lists = ["actions", "decisions", "blockers", "next_actions", "files_mentioned"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, t string")
    p = df.select("i", strict_extraction("t").alias("p"))
    got = [(r.i, r.p is not None, (r.p.goal if r.p else None),
            tuple("|".join(r.p[c]) for c in lists) if r.p else None)
           for r in p.orderBy("i").collect()]
    con = duckdb.connect()
    con.register("a0", pd.DataFrame({"i": range(len(answers)), "t": answers}))
    ok = O.shape_ok("vj", ["summary", "goal"], lists)
    lcols = ", ".join(f"array_to_string({O.jlist('jb', c)}, '|')" for c in lists)
    sql = f"""WITH a1 AS (SELECT i, CASE WHEN json_valid(t) THEN t ELSE '"not json"' END AS vj FROM a0),
              a2 AS (SELECT i, {ok} AS ok, vj FROM a1),
              a3 AS (SELECT i, ok, CASE WHEN ok THEN vj ELSE '{{}}' END AS jb FROM a2)
              SELECT i, ok, CASE WHEN ok THEN {O.jstr('jb', 'goal')} END, CASE WHEN ok THEN [{lcols}] END
              FROM a3 ORDER BY i"""
    want = [(r[0], r[1], r[2], tuple(r[3]) if r[3] is not None else None) for r in con.sql(sql).fetchall()]
    assert got == want
