"""Near-copy components against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from briefloom.llm.jaccard_join import drop_near_copies, jaccard_components, shingle_set


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[top(i)] = top(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        first[top(i)] = min(k, first.get(top(i), k))
    return {k: (len(sets[i]), first[top(i)]) for i, (k, _) in enumerate(rows)}


def texts(seed, families=14, members=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n", "a", "A", "a b c", "A  b\tC", "a b c d e", "x " * 30_000, "x " * 9]
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += [word() for _ in range(rng.randrange(30))]
            out.append((passage + " " if rng.random() < 0.4 else "") + " ".join(x.upper() if rng.random() < 0.1 else x for x in t))
    return out


@pytest.mark.parametrize("seed,rounds", [(1, 3), (2, 0)])
def test_equals_all_pairs(spark, seed, rounds):
    rows = [(7 * i + 3, t) for i, t in enumerate(texts(seed))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, star_rounds=rounds).collect()}
    assert got == brute(rows)


def test_shingle_counts():
    for t in texts(3):
        assert len(shingle_set((t or "").encode(), _Hashes())) == len(shingles(t))


class _Hashes(dict):
    def __missing__(self, w):
        return hash(w) & (1 << 64) - 1


def test_kept_rows_repeated_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(4, t, "k"), (4, t + " more", "l"), (None, t, "m"), (9, "", "n"), (9, None, "o")],
                               "doc_id long, text string, row string")
    got = drop_near_copies(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert len(kept) == 3 and sorted(r.row for r in kept)[-2:] == ["n", "o"] and sum(r.doc_id == 4 for r in kept) == 1
    assert jaccard_components(df.limit(0)).count() == 0 and drop_near_copies(df.limit(0)).count() == 0
    assert drop_near_copies(df.where(F.col("doc_id") == 9)).count() == 2


def test_order_is_by_hash():
    s = shingle_set(b"a b c d e f g h", _Hashes())
    assert (s[1:] > s[:-1]).all()  # a difference of hashes can overflow
