"""Near copies by HyperMinHash against all pairs, and the estimate against real similarities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import hyperminhash as H


def shingles(text, size=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").encode().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, similarity=80):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= similarity * len(a | sets[j]):
                up[top(i)] = top(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        first[top(i)] = min(k, first.get(top(i), k))
    return {k: (len(sets[i]), first[top(i)], first[top(i)] == k) for i, (k, _) in enumerate(rows)}


def texts(seed, families=14, members=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n", "a", "A", "a b c", "A  b\tC", "a b c d e", "x " * 30_000, "x " * 9]
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += [word() for _ in range(rng.randrange(30))]
            out.append((passage + " " if rng.random() < 0.4 else "") + " ".join(x.upper() if rng.random() < 0.1 else x for x in t))
    return out


@pytest.mark.parametrize("seed,rounds", [(1, 3), (2, 0)])
def test_equals_all_pairs(spark, seed, rounds):
    rows = [(7 * i + 3, t) for i, t in enumerate(texts(seed))]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, n int, component_id int, bands string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_copies(df, hub_rounds=rounds).collect()}
    assert got == brute(rows)


def test_a_pair_at_the_threshold_is_met_in_some_band():
    rng = np.random.default_rng(5)
    missed = 0
    for n in (5, 10, 45, 90, 450, 4500):
        for _ in range(60):
            same = rng.integers(0, 1 << 63, n * 8 // 10 if n > 5 else 4, dtype=np.uint64) * np.uint64(2)
            extra = rng.integers(0, 1 << 63, n - len(same), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.sort(np.concatenate([same, extra[::2]])), np.sort(np.concatenate([same, extra[1::2]]))
            regs = H.registers(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            keys, used = H.bands(regs)
            missed += not ((keys[0] == keys[1]) & used[0] & used[1]).any()
    assert missed == 0


def test_registers_hold_zeros_and_mantissa():
    rest = H._REST
    h = np.array([1 << rest - 1 | 1 << rest - 2, 1 << rest | 1 << rest - 3, 2 << rest], np.uint64)
    regs = H.registers(h, np.zeros(3, np.int64), 1)[0]
    assert regs[0] == (0 + 1) << H.MANTISSA | 1 << H.MANTISSA - 1
    assert regs[1] == (2 + 1) << H.MANTISSA
    assert regs[2] == (H.ZEROS + 1) << H.MANTISSA  # no bit set: the cap
    assert not regs[3:].any()


def test_estimate_is_near_the_similarity(spark):
    """Within four standard errors, on sets of equal and of different sizes."""
    rng = np.random.default_rng(3)
    pairs, want = [], []
    for i in range(120):
        n, j = int(rng.integers(200, 4000)), float(rng.uniform(0.1, 0.95))
        pool = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
        common = int(j * len(pool))
        cut = common + int(rng.integers(0, len(pool) - common + 1))
        order = rng.permutation(len(pool))
        a, b = np.sort(pool[order[:cut]]), np.sort(pool[np.concatenate([order[:common], order[cut:]])])
        regs = H.registers(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        lanes = np.concatenate([H.packed(regs), H.bits(regs != 0), np.zeros((2, len(H._PARITIES)), np.int64)], axis=1)
        pairs.append((i, len(a), len(b), *map(int, lanes[0]), *map(int, lanes[1])))
        want.append(common / len(pool))
    names = ["i", "n_a", "n_b", *[f"{c}_a" for c in H._PACKED], *[f"{c}_b" for c in H._PACKED]]
    df = spark.createDataFrame(pairs, ", ".join(f"{c} long" for c in names))
    got = dict(df.select("i", H.estimate("a", "b")[0]).collect())
    for i, j in enumerate(want):
        assert abs(got[i] - j) <= 4 * (j * (1 - j) / H.BUCKETS) ** 0.5 + 0.02


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for n in (3, 50, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5:], rng.integers(0, 1 << 63, n // 7 + 1, dtype=np.uint64)]))
        x = H.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert 0 < (x[0] ^ x[1]).sum() <= len(np.setxor1d(a, b))


def test_repeated_and_null_ids_and_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(4, t, "k"), (4, t + " more", "l"), (None, t, "m"), (9, "", "n"), (9, None, "o")],
                               "doc_id long, text string, rep string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.near_copies(df).collect()), key=str)
    assert sorted(got, key=str) == sorted([(4, 47, 4, True), (4, 48, 4, False), (None, 47, 4, False), (9, 0, 9, True), (9, 0, 9, True)], key=str) \
        or sorted(got, key=str) == sorted([(4, 47, 4, False), (4, 48, 4, True), (None, 47, 4, False), (9, 0, 9, True), (9, 0, 9, True)], key=str)
    assert H.near_copies(df.limit(0)).count() == 0
    assert H.near_copies(df.where(F.col("doc_id") == 9)).count() == 2
