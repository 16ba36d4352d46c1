"""The pipeline's stages against brute force, each on its own input."""

import random
import zlib

import numpy as np

import corpus_pipeline
from briefloom.llm import toxicity
from briefloom.llm.packing import WordIds, default_tokenizer

from .test_jaccard_join import brute as brute_components
from .test_mixing import brute as brute_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 12)))
    shared = [line() for _ in range(4)]
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    for t in texts[:10]:  # near copies, and one exact copy each
        w = t.replace("\n", " \n ").split(" ")
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).replace(" \n ", "\n"))
        texts.append(t)
    texts += [f"{line()}\n{rng.choice(shared)[:-1]}{rng.choice('xy')}\n{line()}" for _ in range(20)]
    texts += [f"{line()} you {w} {line()}" for w in ("idiot", "moron", "scum", "zorgling", "zorgen", "zorg", "idiot", "moron") * 3]
    texts += [None, "", " \n", "short"]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    toxic = {i: int(any(w in (t or "") for w in ("idiot", "moron", "scum", "zorg"))) for i, t, *_ in rows}
    return rows, [(i, 1, x) for i, x in toxic.items() if i % 3]


def distance(a, b, most):
    """Edit distance by the plain table; anything above ``most`` may come back as more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        if min(row) > most:
            return most + 1
    return row[-1]


def near(a, b):
    """Two character edits, or a word edit for every ten words of the longer line."""
    x, y = a.split(), b.split()
    most = max(len(x), len(y)) // 10
    return distance(a, b, 2) <= 2 or distance(x, y, most) <= most


def brute_lines(rows):
    lines = [(k, p, x) for k, t in rows for p, x in enumerate((t or "").split("\n")) if len(x) >= 20]
    words = sorted({x for *_, x in lines})
    up = {w: w for w in words}

    def top(w):
        while up[w] != w:
            w = up[w]
        return w

    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if near(a, b):
                up[top(a)] = top(b)
    first, gone = {}, set()
    for k, p, x in sorted(lines):
        if first.setdefault(top(x), (k, p)) != (k, p):
            gone.add((k, p))
    out = {}
    for k, t in rows:
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)
        if kept == t or (kept or "").strip(" \t\n\x0b\f\r"):
            out[k] = kept
    return out


def test_stages_and_run(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_copies", "mix", "pack"]

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    grammar = toxicity.train(now, marks)
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.select(*COLUMNS).collect()]
        texts = {r[0]: r[1] for r in before}
        out = stage(spark, now, str(tmp_path))
        if name == "pack":
            break
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(r) for r in now.collect()]
        if name == "toxicity":
            kept = {i for i, t in texts.items() if grammar.score(t or "") < 0.3}
            assert sorted(after, key=str) == sorted((r for r in before if r[0] in kept), key=str)
            assert not any("idiot" in (t or "") or "zorg" in (t or "") for _, t, *_ in after) and len(after) > 80
        elif name == "line_dedup":
            want = brute_lines([(r[0], r[1]) for r in before])
            assert {r[0]: r[1] for r in after} == want and all(r[4] == len(r[1] or "") for r in after)
        elif name == "near_copies":
            comp = brute_components(sorted(texts.items()))
            assert sorted(r[0] for r in after) == sorted(i for i, (_, c) in comp.items() if c == i)
        elif name == "mix":
            want, *_ = brute_mix([(r[0], r[1], r[3]) for r in before])
            assert sorted(r[0] for r in after) == sorted(i for i, (size, _, taken) in want.items() for _ in range(taken // max(1, size)))
    packed = out.collect()
    tok = WordIds(default_tokenizer()).tokenizer
    want = []
    for i, t, *_ in before:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048

    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in ran) == sorted(want)


OWN = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, lines_dropped string, row string, _key string"


def test_own_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    line = "this is a line of more than twenty characters that comes again"
    rows = [(i, t, "en", s, len(t or ""), f"s{i}", f"p{i}", f"l{i}", f"r{i}", f"k{i}") for i, t, s in [
        (1, f"{line}\nfirst own line of the first document", "a"), (2, f"{line}\nsecond own line of the second document", "a"),
        (3, None, None), (4, "", "b"), (5, "you idiot, you moron, you scum", "b"), (6, "a calm text about nothing at all", "b")]]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, OWN)
    spark.createDataFrame([(i, 1, int(i == 5)) for i in range(1, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "line_dedup", "near_copies", "mix"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert (r.score, r.predicted, r.lines_dropped, r.row, r["_key"]) == tuple(f"{c}{r.doc_id}" for c in "splrk"), name
        kept = sorted(r.doc_id for r in out.collect())
        if name == "toxicity":
            assert set(kept) == {1, 2, 3, 4, 6} and len(kept) == 6
        elif name == "line_dedup":
            texts = [r.text for r in out.collect()]
            assert sum(line in (t or "") for t in texts) == 1 and set(kept) == {1, 2, 3, 4, 5, 6}
        elif name == "near_copies":
            assert kept == [1, 2, 3, 4, 5, 6]
        empty = stages[name](spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.dtypes == docs.dtypes
    assert stages["pack"](spark, docs, str(tmp_path)).count() == 7
    assert stages["pack"](spark, docs.limit(0), str(tmp_path)).count() == 0
