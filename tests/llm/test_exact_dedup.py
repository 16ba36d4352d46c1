"""Exact dedup against brute force, also with a hash that collides."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from briefloom.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(groups[n])[1], len(groups[n]), min(groups[n])[1] == i, hashlib.sha256(n.encode()).hexdigest())
            for i, t in rows for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]}


def texts():
    rng = random.Random(1)
    base = ["".join(rng.choice("ab é漢😀") for _ in range(rng.randrange(0, 60))) for _ in range(20)]
    out = [None, "", " \t\n\x0b\f\r", "x" * 5000, "x" * 5001, "x" * 4999 + "y", "x " * 2500, " ", "\x1c"]
    for _ in range(150):
        t = rng.choice(base)
        at = rng.randrange(len(t) + 1)
        out.append(t[:at] + rng.choice([" ", "\n\n", "", "", "z"]) + t[at:])
    return out


@pytest.mark.parametrize("block,weak", [(4096, False), (7, False), (3, True)])
def test_equals_brute_force(spark, block, weak):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _key int, name string")
    hashed = (lambda c: F.pmod(F.xxhash64(c), F.lit(5))) if weak else F.xxhash64
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, block=block, hashed=hashed).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "ab"), (None, "a b"), (2, "ab"), (None, None)], "doc_id int, text string")
    got = exact_dedup(df).collect()
    same = [r for r in got if r.group_size == 4]
    assert len(same) == 4 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {5}
    assert exact_dedup(df.limit(0)).count() == 0
