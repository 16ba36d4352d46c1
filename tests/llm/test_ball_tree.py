"""Ranked search against scoring every document, and the trees' bounds."""

import math
import random
import re

import numpy as np

from briefloom.llm import ball_tree as B

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    tokens = {k: words(t) for k, t in docs}
    n_docs, n_terms = sum(bool(t) for t in tokens.values()), sum(map(len, tokens.values()))
    df = {}
    for t in tokens.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for k, t in tokens.items():
            if not t:
                continue
            m = 100 - 90 + (90 * len(t) * n_docs) // n_terms
            score = 0
            for x in set(words(text)):
                tf = t.count(x)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(x, 0) + 1)))
                score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, k))
        out += [(item, i, k, -s) for i, (s, k) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé7") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    word = lambda: vocabulary[min(int(rng.expovariate(0.02)), 399)]
    items = [(i // 2 if i < 4 else i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(50, None), (51, " .-\n"), (52, "neverseen"), (53, vocabulary[0].upper())]
    docs = []
    for i in range(n):
        t = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.2:
            t += rng.choice(items[:12])[1].split()
        docs.append((3 * i + 1, rng.choice([" ", "-", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in t)))
    docs += [(5000 + i, docs[7][1]) for i in range(30)]  # ties
    docs += [(9000, None), (9001, ""), (9002, "a " * 20_000), (9003, "?!")]
    return docs, items


def test_equals_scoring_every_document(spark):
    docs, items = corpus(1)
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, ids string").repartition(5)
    q = spark.createDataFrame([(k, t, 7) for k, t in items], "item_id long, text string, score int")
    items_by_row = [(i, t) for i, (_, t) in enumerate(items)]
    want = sorted((items[i][0], r, k, s) for i, r, k, s in brute(docs, items_by_row))
    got = B.ranked_search(d, q, chunk=64, leaf=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want
    # Several blocks of items and thresholds from a few documents change nothing.
    assert sorted(tuple(r) for r in B.ranked_search(d, q, chunk=64, leaf=4, block_bytes=300, seed_rows=50).collect()) == want


def test_null_and_repeated_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c"), (2, "a"), (3, "z z")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b a"), (None, "z")], "item_id long, text string")
    got = sorted((tuple(r) for r in B.ranked_search(d, q).collect()), key=str)
    assert [(r[1], r[2]) for r in sorted((g for g in got if g[0] == 1), key=lambda r: r[1])] == [(1, 4), (2, 4), (3, None), (4, 2)]
    assert [(r[1], r[2]) for r in got if r[0] is None] == [(1, 3)]
    assert B.ranked_search(d.limit(0), q).count() == 0 and B.ranked_search(d, q.limit(0)).count() == 0


def _vectors(seed, n=300, dims=500):
    rng = np.random.default_rng(seed)
    ids = [np.sort(rng.choice(dims, rng.integers(1, 40), replace=False)).astype(np.int32) for _ in range(n)]
    ids[5:20] = [ids[4]] * 15
    y = [rng.integers(1, 10**10, len(i)) for i in ids]
    y[5:20] = [y[4]] * 15
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    return starts, np.concatenate(ids), np.concatenate(y), [np.sort(rng.choice(dims, 12, replace=False)) for _ in range(20)]


def test_no_row_exceeds_the_bound_of_any_node_above_it():
    for blocks in (1, 16, 256):
        starts, ids, y, items = _vectors(2)
        tree = B.BallTree(starts, ids, y, 8, blocks)
        bounds = tree.bounds(items)

        def below(node):
            if tree.children[node] is None:
                return tree.rows[node]
            return np.concatenate([below(c) for c in tree.children[node]])

        assert sorted(below(0)) == list(range(300))
        for i, t in enumerate(items):
            mine = np.isin(tree.dims, t)
            for node in range(len(tree.children)):
                assert tree.scores(below(node), mine).max() <= bounds[node, i]


def test_subtrees_are_pruned():
    """Groups of like vectors: most leaves are never opened."""
    rng = np.random.default_rng(7)
    ids, y = [], []
    for g in range(64):
        base = rng.choice(2000, 20, replace=False)
        for _ in range(16):
            ids.append(np.sort(base).astype(np.int32))
            y.append(rng.integers(9 * 10**8, 10**9, 20))
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    tree = B.BallTree(starts, np.concatenate(ids), np.concatenate(y))
    items = [np.unique(ids[16 * g]) for g in range(0, 64, 8)]
    best = [[] for _ in items]
    opened = B.search(tree, np.arange(len(ids)), items, best, [1] * len(items))
    leaves = sum(c is None for c in tree.children)
    assert opened < leaves * len(items) / 4
    for g, heap in zip(range(0, 64, 8), best, strict=True):
        assert {-k // 16 for _, k in heap} == {g}
