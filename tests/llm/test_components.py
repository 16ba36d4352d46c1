"""Components of links and how their tables are written."""

import random

import pytest

from briefloom.llm import common as m
from briefloom.llm.common import components


def brute(edges):
    up = {v: v for e in edges for v in e}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {v: top(v) for v in up}


def graphs():
    rng = random.Random(1)
    yield [(i, i + 1) for i in range(70)]
    yield [(i + 1, i) for i in range(70)] + [(0, 1), (1, 0)]
    yield [(500 + i, rng.randrange(500)) for i in range(200)]
    yield [(rng.randrange(300), 300 + rng.randrange(300)) for _ in range(250)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("edges", list(graphs()))
def test_equal_brute_force_and_go_on_from_known_ones(spark, edges):
    got = components(frame(spark, edges)).collect()
    assert len(got) == len(brute(edges)) and {r.v: r.label for r in got} == brute(edges)
    known = components(frame(spark, edges[::2]))
    assert {r.v: r.label for r in components(frame(spark, edges[1::2]), known).collect()} == brute(edges)


def test_no_edges(spark):
    assert components(frame(spark, [])).collect() == []
    known = components(frame(spark, [(1, 2)]))
    assert {tuple(r) for r in components(frame(spark, []), known).collect()} == {(1, 1), (2, 1)}


def test_edges_within_a_component_are_written_once(spark, monkeypatch):
    written = []
    stored = m.stored

    def counted(df, purpose):
        out = stored(df, purpose)
        if purpose == "edges":
            written.append(out.count())
        return out

    monkeypatch.setattr(m, "stored", counted)
    edges = [(i, j) for i in range(30) for j in range(i)]
    components(frame(spark, edges))
    assert written == [len(edges), 0]


def test_tables_are_not_written_by_a_file_for_each_partition_and_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, want in ((8, 8), (200, 256), (211, 211)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert m.partitions(spark) == want
            with m._writing(spark):
                assert spark.conf.get(m._AT_FIRST) == str(want)
            assert spark.conf.get(m._AT_FIRST, None) is None and spark.conf.get(m._CLEANUP, None) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
