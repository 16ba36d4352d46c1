"""The mix against a direct queue."""

import hashlib
import random

import pytest

from briefloom.llm.mixing import mix, mixed


def brute(rows, ratio=1.5, epochs=2, weights=(3, 1, 2)):
    size = {i: len((t or "").replace("\x0b", " ").encode().split()) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s.encode() if s else b""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    budget, target, open_ = ratio * sum(total.values()), {}, list(names)
    left = budget
    while open_:
        share = left / sum(w[s] for s in open_)
        full = [s for s in open_ if epochs * total[s] <= share * w[s]]
        if not full:
            target |= {s: share * w[s] for s in open_}
            break
        for s in full:
            target[s] = float(epochs * total[s])
            left -= target[s]
            open_.remove(s)
    u = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16)
    entries = []
    for k, s in enumerate(names):
        done = 0
        for e in range(epochs):
            for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (u(i), i)):
                done += size[i]
                if size[i]:
                    entries.append((done / w[s], e, k, u(i), i))
    taken, words = dict.fromkeys(size, 0), 0
    for f, e, k, _, i in sorted(entries):
        words += size[i]
        if words > budget:
            break
        taken[i] += size[i]
    return {i: (size[i], total[s], taken[i]) for i, _, s in rows}, {i: target[s] for i, _, s in rows}, total, target


@pytest.mark.parametrize("bucket", [256, 3])
def test_equals_direct_queue(spark, bucket):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " ", "w " * rng.randrange(1, 40), "é x\ny"]),
             rng.choice(["big"] * 6 + ["a", "é", "B", "", None, "tiny"])) for i in range(400)]
    rows += [(400, None, "void"), (401, "word " * 3000, "B")]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, source string, w int, size int")
    got = mix(df, bucket=bucket).collect()
    want, targets, total, target = brute(rows)
    assert {r.id: (r.size, r.source_size, r.taken) for r in got} == want
    for r in got:
        assert r.target == pytest.approx(targets[r.id])
    assert sorted((r.doc_id, r.source) for r in mixed(df).collect()) == sorted(
        ((i, s) for i, _, s in rows for _ in range(want[i][2] // max(1, want[i][0]))), key=lambda x: x) if None not in {
        s for i, _, s in rows if want[i][2]} else True


def test_sources_come_near_their_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice("aaaabbc")) for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.idx, [r.target, 0])[1] += r.taken
    for target, taken in by.values():
        assert abs(taken - target) <= 60


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    got = mix(df).collect()
    assert len(got) == 3 and sum(r.taken for r in got) <= 7.5
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0
