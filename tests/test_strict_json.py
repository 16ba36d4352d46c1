"""The strict decoder of the JVM against the plain one, letter by letter."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefloom.functions.json_strict import EXTRACTION_SHAPE, HOOK_SHAPE, PLAN_SHAPE, strict_decode
from strict_reference import canonical_json

DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


@pytest.fixture(autouse=True)
def duplicates(spark):
    spark.conf.set(DUPLICATES, "true")
    yield
    spark.conf.unset(DUPLICATES)


def _same(spark, texts, shape):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = {r.i: r.p.asDict(True) if r.p else None for r in df.select("i", strict_decode("t", shape).alias("p")).collect()}
    for i, t in enumerate(texts):
        want = canonical_json(t, shape)
        assert got[i] == (None if want is None else json.loads(want)), t


TEXTS = [
    None, "", " ", "null", " null\n", "null x", "nul", "true", "3", '"s"', "[]", "{}", " {} \r\n", "{}{}", "{} x", "{},{}", "{}],[", '{}],["', "{}]", "[{}]",
    "﻿{}", "\x0b{}", " {}", "{'goal': 'x'}", '{goal: "x"}', '{"goal": "x",}', '{"goal": NaN}', '{"x": NaN}', '{"x": Infinity}', '{"x": -Infinity}',
    '{"x": 01}', '{"x": .5}', '{"x": 1.}', '{"x": +1}', '{"x": 1e999}', '{"x": -0}', '{"x": ' + "9" * 400 + "}", '{"goal": "a\nb"}', '{"goal": "a\\nb"}', '{"goal": "\\x"}',
    '// c\n{}', '{"goal": 1}', '{"goal": "a", "goal": null}', '{"goal": "a", "GOAL": "b"}', '{"GOAL": "b", "goal": "a"}', '{"goal": 1, "goal": "a"}',
    '{"goal": "a", "Goal": 1}', '{"goal": "12", "summary": "[1]", "actions": ["{}", "null"]}', '{"actions": null}', '{"actions": "x"}', '{"actions": [1]}', '{"actions": [["x"]]}',
    '{"actions": ["a"], "ACTIONS": null}', '{"actions": [null, "a", null]}', '{"actions": []}', '{"actions": {"a": "b"}}', '{"next_actionſ": ["k"], "blocKers": ["b"]}',
    '{"extra": {"a": 1, "a": 2}, "goal": "g"}', '{"extra": [{"a": {"b": [1, 2.5, true, null]}}], "goal": "g"}', '{"goal": "\\ud83d\\ude00"}', '{"goal": "\\ud83d"}', '{"goal": "x\\ude00y"}',
    '{"goal": "\\ud83d\\ud83d\\ude00"}', '{"goal": "\\\\ud83d"}', '{"goal": "\\\\\\ud83d"}', '{"goal": "\\uD83Dx\\uDE00"}', '{"goal": "\\u00e9\\u0041"}', '{"goal": "é😀"}', '{"\\u0067oal": "escaped key"}',
    '{"goal": "' + "long " * 5000 + '"}', '{"summary": "a", "goal": "b", "decisions": ["c"], "blockers": ["d"], "next_actions": ["e"], "files_mentioned": ["f"]}',
]
REFS = [
    '{"relevant_files": null}', '{"relevant_files": []}', '{"relevant_files": [null, {"path": "p"}]}', '{"relevant_files": ["p"]}', '{"relevant_files": [3]}', '{"relevant_files": [[]]}',
    '{"relevant_files": {"path": "p"}}', '{"relevant_files": [{"path": 1}]}', '{"relevant_files": [{"path": "a", "Path": "b", "path": "c", "reason": null, "x": {"y": 1}}]}',
    '{"relevant_files": [{"Path": "b", "path": "a"}]}', '{"relevant_files": [{"path": "a", "PATH": 2}]}', '{"relevant_files": [{"path": "a", "path": null, "REASON": "r"}, {}, null]}',
    '{"relevant_files": [{"path": "a"}], "Relevant_Files": [{"reason": "r"}]}', '{"relevant_files": ["bad"], "relevant_files": [{"path": "a"}]}', '{"relevant_files": [{"path": "a"}], "relevant_files": null}',
    '{"goal": "g", "relevant_files": [{"path": "{}", "reason": "[1, 2]"}], "execution_plan": ["a", null], "why_now": null}', '{"relevant_files": [{"path": "\\ud83d", "reason": "\\\\"}]}', '{"relevant_files": "null"}',
]


@pytest.mark.parametrize("shape", [EXTRACTION_SHAPE, PLAN_SHAPE, HOOK_SHAPE])
def test_written_cases(spark, shape):
    _same(spark, TEXTS + REFS, shape)


_leaf = st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False, width=16) | st.text(alphabet='ab é"\\\n{}[]:,😀', max_size=5)
_value = st.recursive(_leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["path", "reason", "Path", "k"]), x, max_size=3), max_leaves=6)
_known = st.sampled_from([*PLAN_SHAPE, "GOAL", "Title", "Relevant_files", "RELEVANT_FILES", "other"])
_fitting = st.lists(st.none() | st.fixed_dictionaries({}, optional={"path": st.text(max_size=3) | st.none(), "Path": st.text(max_size=3), "reason": st.text(max_size=3)}), max_size=3) \
    | st.lists(st.none() | st.text(max_size=4), max_size=3) | st.text(max_size=6) | st.none()


def _dump(pairs):
    return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=i % 2 == 0)}" for i, (k, v) in enumerate(pairs)) + "}"


_texts = st.tuples(st.lists(st.tuples(_known, _fitting | _value), max_size=5).map(_dump), st.sampled_from(["", "", "", " ", "\n", " x", "{}", "]", ",1"])).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_texts, min_size=10, max_size=40))
def test_generated_texts(spark, texts):
    _same(spark, texts, PLAN_SHAPE)


def test_no_python_in_the_plan_and_repeated_inner_keys_without_the_setting(spark):
    df = spark.createDataFrame([('{"x": {"a": 1, "a": 2}, "goal": "g"}',), ('{"goal": "g"}',)], "t string")
    out = df.select(strict_decode("t", EXTRACTION_SHAPE)["goal"].alias("goal"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert [r.goal for r in out.collect()] == ["g", "g"]
    spark.conf.unset(DUPLICATES)
    assert [r.goal for r in df.select(strict_decode("t", EXTRACTION_SHAPE)["goal"].alias("goal")).collect()] == [None, "g"]
