"""The conversation trie against a direct one, and the double arrays by themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import prefix_trie as T


def rule():
    return F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x, key=lambda r: r[:2])] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        subtree = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in subtree if len(p) == len(path) + 1]
        leaves = [p for p in subtree if not any(q[:-1] == p for q in subtree if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=60, longest=12):
    rng = random.Random(seed)
    texts = ["", None, "hi", "Ünï", "a\nb", "x" * 40]
    out = []
    for c in [*range(-7, n), 10**12, 10**12 + 3]:
        if rng.random() < 0.15:
            continue
        for turn in range(rng.randrange(1, longest)):
            out.append((c, None if turn == 0 and rng.random() < 0.3 else turn, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return out


@pytest.mark.parametrize("seed,layer,shard,fan", [(1, 256, 65_536, 256), (2, 3, 20, 2), (3, 2, 7, 3)])
def test_equals_a_direct_trie(spark, seed, layer, shard, fan):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(7)
    got = T.conversation_trie(df, *rule(), layer, shard, fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rebuilt(rows))


def test_one_conversation_copied_many_times_and_one_long(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    rows += [(1000, t, "user", "again") for t in range(700)] + [(1001, t, "user", "again") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = {}
    for c, _, r, x in rows:
        convs.setdefault(c, []).append((r, x))
    got = T.conversation_trie(df, layer=64, shard=100, fan=2)
    got = {(r.conv_id, r.depth): tuple(r) for r in got.collect()}
    assert len(got) == 1 + 4 + 700
    assert got[0, 0][3:6] == (302, 2, 2)
    assert got[0, 4][3:7] == (300, 0, 1, 299 * len("turn 3"))
    assert got[0, 4][7] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    assert got[1000, 300][3:7] == (2, 1, 1, 5)
    assert got[1000, 1][6] == 300 * 5 and got[1000, 700][2] == 1000 and got[1000, 301][3] == 1


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 0, "u", "x"), (3, 1, "u", "b"), (3, 1, "u", "b"), (3, 1, "u", "a")], "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in T.conversation_trie(df).collect()), key=lambda r: r[1])
    assert [r[:5] for r in got] == [(3, 0, None, 1, 1), (3, 1, 3, 1, 1), (3, 2, 3, 1, 1), (3, 3, 3, 1, 0)]
    assert T.conversation_trie(df.limit(0), *rule()).count() == 0
    assert T.conversation_trie(df.where("conv_id is null")).count() == 0


def test_double_array_holds_just_what_was_inserted():
    rng = np.random.default_rng(1)
    trie = T.DoubleArray(3)
    states, held, total = np.arange(3), {}, 0
    for _ in range(5):
        pairs = sorted({(int(s), int(x)) for s in rng.choice(states, 400) for x in rng.integers(1, 500, rng.integers(1, 4))})
        s, x = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        slots = trie.insert(s, x)
        held |= dict(zip(pairs, slots.tolist(), strict=True))
        states, total = slots, total + len(pairs)
    assert len(set(held.values())) == total
    s, x = np.array([k[0] for k in held]), np.array([k[1] for k in held])
    assert (trie.step(s, x) == np.array(list(held.values()))).all()
    for s in list({k[0] for k in held})[:50]:
        labels = np.arange(0, 600)
        got = trie.step(np.full(600, s), labels)
        assert {int(x) for x in labels[got >= 0]} == {x for t, x in held if t == s}
    assert trie.top < 2 * total + 500
