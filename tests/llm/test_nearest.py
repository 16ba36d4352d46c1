"""Recall against brute force, and the odd vectors."""

import os
import random
import threading

import numpy as np

from briefloom.llm import nearest as module
from briefloom.llm.nearest import Asked, Block, Index, adaptive_scan, nearest
from briefloom.session import local_path


def brute(rows, k=20, every=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1)) + rng.standard_normal((8, 24))[rng.integers(8, size=1500)]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1500 + i, x[7].tolist()) for i in range(700)]  # a third are copies of one vector
    got = {}
    for r in nearest(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, rank string"), every=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want, hits = brute(rows, every=100), 0
    assert got.keys() == want.keys()
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert [i for _, i, s in mine] == [i for _, i, s in sorted(mine, key=lambda r: (-r[2], r[1]))]
        for _, i, s in mine:
            assert abs(s - float(np.dot(rows[q][1], rows[i][1]))) < 1e-9 and i != q
        hits += len({i for _, i, _ in mine} & {i for i, _ in near})
    assert hits >= 0.9 * 20 * len(want)


def test_scan_without_margin_loss():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((500, 33)), rng.standard_normal(33)
    rows, dist = adaptive_scan(x, q, 10, float("inf"), epsilon=1e9)
    assert sorted(rows.tolist()) == sorted(np.argsort(((x - q) ** 2).sum(1))[:10].tolist())
    assert np.allclose(dist, ((x[rows] - q) ** 2).sum(1))


def test_odd_vectors_and_few_candidates(spark):
    r = random.Random(3)
    v = lambda: [r.uniform(-1, 1) for _ in range(4)]
    good = [(20 * i, v()) for i in range(6)]
    odd = [(140, None), (160, []), (180, [0.0] * 4), (200, [1.0, None, 0.0, 0.0]), (220, [1.0, float("nan"), 0.0, 0.0]),
           (240, [float("inf"), 0.0, 0.0, 0.0]), (260, [1.0, 2.0]), (None, v())]
    df = spark.createDataFrame([*good, good[0], *odd], "vec_id long, embedding array<double>")
    got = nearest(df).collect()
    assert {x.query_id for x in got} == {i for i, _ in good}
    for q, _ in good:
        assert {x.id for x in got if x.query_id == q} == {i for i, _ in good} - {q}
        assert sorted(x.rank for x in got if x.query_id == q) == [1, 2, 3, 4, 5]
    assert nearest(df.limit(0)).count() == 0


def test_disk_follows_the_table(spark, tmp_path):
    """Neither what is stored nor what is shuffled holds copies of vectors for the lists and queries that they meet."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((16_000, 64)).astype("f4")
    table = str(tmp_path / "embeddings")
    (spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
     .write.option("parquet.enable.dictionary", "false").parquet(table))
    folders = [local_path(spark.conf.get("spark.checkpoint.dir")),
               *(d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]

    def size(*tops):
        total = 0
        for d, _, names in (w for top in tops for w in os.walk(top)):
            for name in names:
                try:
                    total += os.stat(os.path.join(d, name)).st_size
                except OSError:
                    pass
        return total

    before, seen, over = size(*folders), [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            seen.append(size(*folders))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = nearest(spark.read.parquet(table)).collect()
    finally:
        over.set()
        watcher.join()
    assert max(seen) - before < 4 * size(table), (max(seen) - before, size(table))
    # The same rows as scoring all, but for what the index misses.
    want = brute(list(enumerate(x.tolist())), every=400)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, {})[r.id] = r.score
    assert len(mine) == 800 and all(len(v) == 20 for v in mine.values())
    assert sum(len(mine[q].keys() & {i for i, _ in near}) for q, near in want.items()) >= 0.85 * 20 * len(want)
    for q in want:
        for i, score in mine[q].items():
            assert abs(score - float(np.dot(x[q].astype(float), x[i].astype(float)))) < 1e-9


def test_rows_of_queries_and_blocks(monkeypatch):
    """Tiles, pairs and heads give what scoring every vector of the scanned lists gives, whatever their sizes."""
    rng = np.random.default_rng(5)
    for norms in (rng.uniform(0.5, 1, (900, 1)), np.r_[np.full((899, 1), 1e-5), [[1e4]]]):  # the second has one very long vector
        v = rng.standard_normal((900, 20)) * norms
        index = Index(v, float(np.sqrt((v * v).sum(1)).max()), 900)
        assert index.real == (np.float32 if norms.min() >= 0.5 else np.float64)
        lists = index.list_of(v)
        order = np.argsort(lists, kind="stable")
        near = np.argsort(index.distances(index.rotate(v[:60], query=True)), axis=1, kind="stable")[:, :index.probes]
        for tile, pairwise in (((1024, 512), 64), ((7, 11), 1), ((16, 900), 10_000_000)):
            monkeypatch.setattr(module, "_TILE", tile)
            monkeypatch.setattr(module, "_PAIRWISE", pairwise)
            monkeypatch.setattr(module, "EPSILON", 1e9)
            asked = [Asked(index, np.arange(60), v[:60], np.full(60, -np.inf), home, 10) for home in (True, False)]
            for at in range(0, 900, 250):
                o = order[at:at + 250]
                for a in asked:
                    a.meet(Block(index, o, lists[o], v[o]))
            for a, scanned in zip(asked, (near[:, :1], near[:, 1:]), strict=True):
                rows = a.rows().to_pydict()
                got = {}
                for q, i, s in zip(rows["q"], rows["rid"], rows["score"], strict=True):
                    got.setdefault(q, []).append((-s, i))
                for q in range(60):
                    there = np.flatnonzero(np.isin(lists, scanned[q]))
                    scores = np.cumsum(v[there] * v[q], axis=1)[:, -1]
                    assert sorted(got.get(q, [])) == sorted(zip(-scores, there.tolist(), strict=True))[:10]
