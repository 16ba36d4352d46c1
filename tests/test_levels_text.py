"""Detail levels, the goal tokenizer, relevance scoring and JSON extraction."""

import pytest

from briefloom.functions import levels as L
from briefloom.functions.json_strict import EXTRACTION_SHAPE, PLAN_SHAPE
from strict_reference import canonical_json
from briefloom.functions.text import extract_json_block, relevance_haystack, relevance_score, tokenize

LEVEL_CASES = [("compact", "compact", True), ("standard", "standard", True), ("detailed", "detailed", True),
               ("full", "detailed", True), ("", "standard", True), ("bogus", "standard", False)]


def test_level_parsing(spark):
    df = spark.createDataFrame(LEVEL_CASES, "s string, want string, valid boolean")
    got = df.select("want", "valid", L.normalize_level("s").alias("lvl"), L.level_is_valid("s").alias("ok")).collect()
    assert all(r.lvl == r.want and r.ok == r.valid for r in got)


def test_level_limits(spark):
    df = spark.createDataFrame([("compact", 2, 3), ("standard", 5, 8), ("detailed", 10, 15)],
                               "lvl string, outputs int, docs int")
    got = df.select("outputs", "docs", L.max_outputs("lvl").alias("o"), L.max_docs("lvl").alias("d")).collect()
    assert all(r.o == r.outputs and r.d == r.docs for r in got)


def test_requested_level_precedence(spark):
    rows = [("", True, True, "compact"), ("", False, True, "detailed"), ("standard", True, False, "standard"),
            ("", False, False, "")]
    df = spark.createDataFrame(rows, "level string, c boolean, f boolean, want string")
    got = df.select("want", L.requested_level("level", "c", "f").alias("g")).collect()
    assert all(r.g == r.want for r in got)


def test_tokenizer_bytes_and_stopwords(spark):
    df = spark.createDataFrame([("Fix the AUTH flow, é1 and go-to my db",)], "g string")
    toks = df.select(tokenize("g")).first()[0]
    # 'é1' is 3 bytes so it is kept; 'go', 'to', 'db' are dropped; stop words dropped
    assert toks == ["fix", "auth", "flow", "é1"]


def test_relevance_counts_repeats_and_substrings(spark):
    df = spark.createDataFrame([("auth auth flows", "src/authz.go", "handles flows")], "g string, p string, s string")
    assert df.select(relevance_score(tokenize("g"), relevance_haystack("p", "s"))).first()[0] == 3


@pytest.mark.parametrize("raw,want", [
    ('{"a": 1}', '{"a": 1}'),
    ('text ```json\n{"a": 1}\n``` tail', '{"a": 1}'),
    ('```JSON\n{"a": 2}\n```', '{"a": 2}'),
    ('say {"a": {"b": 1}} ok', '{"a": {"b": 1}}'),
    ('no json here', 'no json here'),
    ('  padded  ', 'padded'),
    ('} before {', '} before {'),
    ('```json no close', '```json no close'),
    ('```\n{"a": 3}\n```', '{"a": 3}'),
])
def test_extract_json_block(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(extract_json_block("r")).first()[0] == want


def test_strict_json_rules():
    ok = canonical_json('{"Goal": "g", "actions": ["a", null], "extra": [1, {"x": 2}]}', EXTRACTION_SHAPE)
    assert ok is not None and '"goal": "g"' in ok and '"actions": ["a", ""]' in ok
    assert canonical_json('{"goal": 1}', EXTRACTION_SHAPE) is None          # wrong type
    assert canonical_json('{"goal": "a"} trailing', EXTRACTION_SHAPE) is None  # trailing text
    assert canonical_json('{"goal": "a"}\n{"goal": "b"}', EXTRACTION_SHAPE) is None
    assert canonical_json('[1]', EXTRACTION_SHAPE) is None                  # not an object
    assert canonical_json('null', EXTRACTION_SHAPE) is not None             # null -> defaults
    assert canonical_json('{"goal": NaN}', EXTRACTION_SHAPE) is None
    assert canonical_json('{"goal": "a", "goal": null}', EXTRACTION_SHAPE).count('"goal": "a"') == 1
    assert canonical_json('{"relevant_files": [null, {"path": "p"}]}', PLAN_SHAPE) is not None
    assert canonical_json('{"relevant_files": ["p"]}', PLAN_SHAPE) is None
