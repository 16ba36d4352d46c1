"""Line dedup against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from briefloom.llm import line_dedup as m
from briefloom.llm.line_dedup import _keys, line_dedup, near, probes, segments, within, within_tokens


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abcé"))
        elif s and kind == 1:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abcé")
    return "".join(s)


def test_banded_distance_equals_full_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(0, 5))
        for k in (0, 1, 2, 3):
            assert within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_every_close_pair_shares_a_probed_segment():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(8, 30)))
        b = edited(rng, a, rng.randrange(0, 3))
        if distance(a, b) > 2 or a == b:
            continue
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        index = {(len(short), i, short[p:p + n]) for i, (p, n) in enumerate(segments(len(short), 2))}
        own = {(len(long), i, long[p:p + n]) for i, (p, n) in enumerate(segments(len(long), 2))}
        found = {(length, i, long[p:p + n]) for length, i, p, n in probes(len(long), 2)}
        assert index & (own | found), (a, b)


def brute(rows, edits, min_chars):
    lines = [(k, p, x) for k, t in rows for p, x in enumerate((t or "").split("\n")) if len(x) >= min_chars]
    words = sorted({x for _, _, x in lines})
    up = {w: w for w in words}

    def top(w):
        while up[w] != w:
            w = up[w]
        return w

    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if distance(a, b) <= edits:
                up[top(a)] = top(b)
    first, gone = {}, set()
    for k, p, x in sorted(lines):
        if first.setdefault(top(x), (k, p)) != (k, p):
            gone.add((k, p))
    return {k: (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)) for k, t in rows}


@pytest.mark.parametrize("group,block", [(32, 256), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, group, block):
    from briefloom.llm import line_dedup as m
    monkeypatch.setattr(m.line_links, "__defaults__", (2, group, block))
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefg hé") for _ in range(rng.randrange(8, 26))) for _ in range(25)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, base[0] * 40 + "\n" + base[0] * 40)]
    df = spark.createDataFrame([Row(doc_id=k, text=t, lid=1, _drops="x", h1=2) for k, t in rows])
    got = line_dedup(df, min_chars=10)
    assert got.columns == [*df.columns, "lines_dropped"]
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows, 2, 10)


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a long enough line of text"), (1, "a long enough line of text"), (None, "a long enough line of text")],
                               "doc_id long, text string")
    assert sorted(r.lines_dropped for r in line_dedup(df).collect()) == [0, 1, 1]
    kept = [r for r in line_dedup(df).collect() if r.lines_dropped == 0]
    assert kept[0].doc_id == 1
    assert line_dedup(df.limit(0)).count() == 0


def tokens(line):
    return line.split()


@pytest.mark.parametrize("group,block", [(32, 256), (2, 3)])
def test_long_lines_with_changed_words(spark, monkeypatch, group, block):
    from briefloom.llm import line_dedup as m
    monkeypatch.setattr(m.line_links, "__defaults__", (2, group, block))
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 10))) for _ in range(400)]
    opening = " ".join(rng.choice(vocabulary) for _ in range(12))
    lines = []
    for n in (10, 14, 20, 25, 30, 35, 50, 80, 110):  # words; from 35 on 200 characters and more
        words = [*opening.split(), *(rng.choice(vocabulary) for _ in range(n))][-n - n // 4:]
        for changed in (0, 1, 2, 3):
            new = list(words)
            for i in rng.sample(range(len(new)), changed):
                new[i] = rng.choice(["zzzzzzzz", "", f"{new[i]}, yes", "qqqqqqq"])
            lines.append(" ".join(new))
    rng.shuffle(lines)
    cut = [tokens(x) for x in lines]
    first = list(range(len(lines)))
    pairs = 0
    for i, a in enumerate(cut):
        for j in range(i):
            k = max(len(a), len(cut[j])) // 10
            if abs(len(a) - len(cut[j])) <= max(k, 6) and (distance(lines[i], lines[j]) <= 2 or distance(a, cut[j]) <= k):
                pairs += lines[i] != lines[j]
                first = [min(first[i], first[j]) if f in (first[i], first[j]) else f for f in first]
    assert pairs > 15
    got = {r.doc_id: r.lines_dropped for r in line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: int(f != i) for i, f in enumerate(first)}


def test_one_to_three_changed_words_in_200_to_700_characters(spark):
    rng = random.Random(8)
    rows = []
    for n, changed in ((40, 1), (40, 2), (40, 3), (75, 3), (110, 3)):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 7))) for _ in range(n)]
        new = list(words)
        for i in rng.sample(range(n), changed):
            new[i] = "different"
        assert 200 <= len(" ".join(words)) <= 700
        rows += [" ".join(words), " ".join(new)]
    got = line_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.doc_id: r.lines_dropped for r in got.collect()} == {i: i % 2 for i in range(len(rows))}


def test_near_lines_share_a_key():
    rng = random.Random(9)
    met = 0
    for _ in range(1500):
        a = " ".join(rng.choice(["a", "bc", "def", "", "12"]) + str(rng.randrange(900)) for _ in range(rng.randrange(9, 130)))
        b = tokens(a)
        for _ in range(max(1, len(b) // 10)):
            i = rng.randrange(len(b))
            b[i:i + rng.randrange(2)] = rng.choice([[], ["new"], ["a"]])
        b = " ".join(b) if rng.random() < .7 else edited(rng, a, 2)
        if a == b or not near(a, b, 2):
            continue
        x, y = (dict(zip(out["k"].to_pylist(), out["indexed"].to_pylist(), strict=True))
                for line in (a, b)
                for out in _keys(2)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([line])], ["lid", "line"])])))
        met += 1
        assert any(x[k] or y[k] for k in x.keys() & y.keys()), (a, b)
    assert met > 500


def test_distance_of_tokens_equals_full_distance():
    rng = random.Random(10)
    for _ in range(4000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(0, 7))
        for k in (0, 1, 3, 6):
            assert within_tokens(list(a), list(b), k) == (distance(a, b) <= k), (a, b, k)


def test_tokens_are_hashed_as_they_are_cut(monkeypatch):
    rng = random.Random(11)
    lines = ["".join(rng.choice("ab c　漢字\x85é\U00020001 \t-") for _ in range(rng.randrange(40))) for _ in range(500)]
    want = [(i, t) for i, line in enumerate(lines) for t in m._TOKEN.findall(line)]
    seen = []
    for chunk in (m._CHUNK, 16):  # a line may be longer than a chunk
        monkeypatch.setattr(m, "_CHUNK", chunk)
        m._powers.cache_clear()
        row, hashes, _ = m._token_hashes(lines)
        assert row.tolist() == [i for i, _ in want]
        seen.append(hashes.tolist())
    m._powers.cache_clear()
    of = dict(zip((t for _, t in want), seen[0], strict=True))
    assert len(set(of.values())) == len(of) and [of[t] for _, t in want] == seen[0] == seen[1]


def test_a_line_has_few_keys():
    rng = random.Random(12)
    for n in (12, 25, 39, 58, 130):
        line = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
        out, = _keys(2)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([line])], ["lid", "line"])]))
        assert len(set(out["k"].to_pylist())) == out.num_rows <= max(7, 2 * (n // 10) + 2)


def test_a_common_passage_is_no_key():
    rng = random.Random(13)
    lines = [" ".join([*(f"w{rng.randrange(10 ** 9)}" for _ in range(30)), "all of these lines end in this"]) for _ in range(40)]
    common = m._grams(*m._token_hashes(["all of these lines end in this"])[:2])[1]
    slots = (common % m.np.uint64(m._SLOTS)).astype("int64"), m.np.full(len(common), 200, "uint8")
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(lines)], ["lid", "line"])
    keys = [k for out in _keys(2, slots)(iter([batch])) for k in out["k"].to_pylist()]
    assert len(set(keys)) == len(keys)


def open_rows(lines, shared):
    """Rows of lines that have all of the keys ``shared``, as the steps after ``_met`` take them; ids and labels count the lines."""
    row, token, _ = m._token_hashes(lines)
    width = m.np.bincount(row, minlength=len(lines))
    odd = [x.view("int64").tolist() * len(shared) for x in m._parities(row, token, width)]
    n, ids = len(lines), list(range(len(lines))) * len(shared)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k in shared for _ in range(n)]), pa.array(ids), pa.array(ids), pa.array(width.tolist() * len(shared), pa.int32()),
         pa.array([len(x) % 256 - (len(x) % 256 > 127) * 256 for x in lines] * len(shared), pa.int8()), *(pa.array(x) for x in odd),
         pa.array([True] * n * len(shared)), pa.array([shared] * n * len(shared)), pa.array(lines * len(shared))],
        [*m._OPEN, "indexed", "keys", "line"])


def test_open_groups_make_no_more_rows_than_they_have(monkeypatch):
    # Of 60 lines each two may be near by length and counts, but none are; ten near copies of one are among them.
    rng = random.Random(14)
    lines = ["one and the same opening " + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(60)]
    lines += [lines[0][:-1] + c for c in "ijklmnopqr"]
    rows = open_rows(lines, [5, 7, 9])
    left = pa.Table.from_batches(m._open(2)(iter([rows])))
    assert sorted(zip(left["k"].to_pylist(), left["lid"].to_pylist(), strict=True)) == [(k, i) for k in (5, 7, 9) for i in range(70)]
    seen = []
    verify = m.near_tokens
    monkeypatch.setattr(m, "near_tokens", lambda a, b, *more: seen.append((a, b)) or verify(a, b, *more))
    links = pa.Table.from_batches(m._compared(2)(iter([rows.slice(i, 50) for i in range(0, len(rows), 50)]))).to_pydict()
    assert len(seen) == len(set(seen)) <= 70 * 69 // 2
    assert {x for ab in zip(links["a"], links["b"], strict=True) for x in ab} == {0, *range(60, 70)}
    assert len(links["a"]) == 10  # no link between lines that are joined already


def test_lines_of_unlike_lengths_and_few_words_do_not_meet():
    rows = open_rows(["edes | thshth | are the same", "the | thsh | onornd are the same", "edes | thshth | are the some"], [3])
    left = pa.Table.from_batches(m._open(2)(iter([rows])))
    assert left["lid"].to_pylist() == [0, 2]


def test_blocks_compare_a_pair_in_its_first_group_alone(monkeypatch):
    # All share most of their words; every other pair differs in more of them than edits may change.
    rng = random.Random(15)
    often = [f"w{i}" for i in range(40)]
    lines = [" ".join([*rng.sample(often, 30), *(f"x{rng.randrange(10 ** 6)}" for _ in range(10))]) for _ in range(20)]
    lines += [x.replace("x", "y", 1) for x in lines]
    rows = open_rows(lines, [5, 7]).to_pandas()
    rows["side"] = (rows["lid"] % 2).astype(int)
    seen = []
    verify = m.near_tokens
    monkeypatch.setattr(m, "near_tokens", lambda a, b, *more: seen.append((a, b)) or verify(a, b, *more))
    for same in (False, True):
        seen.clear()
        got = [m._blocks(2)(g.assign(side=0) if same else g) for _, g in rows.groupby("k")]
        links = {(a, b) for g in got for a, b in zip(g["a"], g["b"], strict=True)}
        assert links == {(i, i + 20) for i in range(20)} if same else links <= {(i, i + 20) for i in range(20)}
        assert len(seen) == len(set(seen)) == len(links)
    japanese, accents = "東京 is 大阪", "été\xa0und\x85so fort"
    assert [m.tokens_of(x) for x in (japanese, accents)] == [m._TOKEN.findall(x) for x in (japanese, accents)]


def test_a_group_of_one_label_makes_rows_in_proportion(spark, monkeypatch):
    # 60 copies of one line with one character changed each, and two other lines that share its words: they meet in large groups.
    rng = random.Random(16)
    base = " ".join(f"word{i}" for i in range(30))
    lines = [base[:-1] + chr(0x4e00 + i) for i in range(60)] + [f"{base} {' '.join(f'z{i}{x}' for i in range(12))}" for x in "ab"]
    rng.shuffle(lines)
    blocks = m._blocks
    monkeypatch.setattr(m.line_links, "__defaults__", (2, 8, 8))
    rows = spark.sparkContext.accumulator(0)

    def counted(edits):
        run = blocks(edits)

        def each(group):
            rows.add(len(group))
            return run(group)
        return each

    monkeypatch.setattr(m, "_blocks", counted)
    got = {r.doc_id: r.lines_dropped for r in line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    first = next(i for i, x in enumerate(lines) if "z" not in x)
    assert got == {i: int(i != first and "z" not in x) for i, x in enumerate(lines)}
    assert rows.value <= 4 * len(lines) * 20


def test_pairs_of_an_earlier_group_are_sifted():
    np = m.np
    rng = random.Random(17)
    keys = {i: sorted(rng.sample(range(40), rng.randrange(1, 12))) for i in range(50)}
    rows = sorted((k, i) for i, own in keys.items() for k in own)
    k = np.array([r[0] for r in rows])
    before = m._before(k, np.repeat(np.arange(len(rows)), [len(keys[i]) for _, i in rows]), np.array([x for _, i in rows for x in keys[i]]))
    for x, (key, i) in enumerate(rows):
        for y in range(x):
            if rows[y][0] == key:
                met = any(int(w[x] & w[y]) for w in before)
                assert met == (min({*keys[i]} & {*keys[rows[y][1]]}) < key)


def test_keys_of_more_than_31_bits(spark):
    line = "a long enough line of text"
    for ids in ((1 << 40, (1 << 40) + 1, -(1 << 50)), (-5, 3, 7), (-(1 << 63), 0, (1 << 63) - 1)):
        got = line_dedup(spark.createDataFrame([(i, f"{line}\n{line}") for i in ids], "doc_id long, text string"))
        assert {r.doc_id: r.lines_dropped for r in got.collect()} == {i: 1 + (i != min(ids)) for i in ids}


def test_few_edits_of_tokens_need_no_automaton(monkeypatch):
    rng = random.Random(18)
    for n in (20, 200):
        a = [f"w{rng.randrange(50)}" for _ in range(n)]
        seen = []

        class Seen(str):
            def __hash__(self):
                seen.append(self)
                return str.__hash__(self)

        b = [Seen(x) for x in a]
        b[1], b[-2] = "new", "other"
        assert within_tokens(a, b, 2) and not within_tokens(a, b, 1) and not seen
        assert distance(a, b) == 2


def test_documents_of_many_equal_lines(spark):
    line = "a long enough line of text"
    rows = [(1, "\n".join(["short", line, ""] * 100_000)), (2, "\n".join([line] * 3)), (3, f"{line}\n\nshort\n"), (4, None)]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rest = "\n".join(["short", "", *["short", ""] * 99_998, "short", ""])
    assert got == {1: (f"short\n{line}\n{rest.removeprefix('short\n')}", 99_999), 2: ("", 3), 3: ("\nshort\n", 1), 4: (None, 0)}
