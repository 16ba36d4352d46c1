"""License scans against brute force."""

import random
import re

from briefloom.llm.license_scan import PHRASES, TEMPLATES, Templates, license_scan, words_of


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = brute_words(text)
    starts, base, labels = [], set(), set()
    for k, p in PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        starts += at
        if at:
            base.add(k)
    for k, t in TEMPLATES.items():
        t = brute_words(t)
        for i in range(0, max(1, len(w)), len(t)):
            if 100 * len(set(t) & set(w[i:i + 2 * len(t)])) >= 80 * len(set(t)):
                labels.add("mit" if k == "mit-short" else k)
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)))


def texts():
    rng = random.Random(5)
    filler = "the of and software license free copy Über naïve 2 work in terms public any".split()
    out = [None, "", "  ", "Under the MIT-License. CC_BY_NC cc by nc", "apache\nlicense, VERSION 2 under the mit license",
           "x" * 50_000 + " under the mit license", "underthe mit license", "cc by cc by nc"]
    for t in list(TEMPLATES.values()) * 4:
        words = t.split()
        for _ in range(rng.randrange(0, max(2, len(words) // 3))):
            words[rng.randrange(len(words))] = rng.choice(filler)
        pad = [rng.choice(filler) for _ in range(rng.randrange(0, 120))]
        out.append(" ".join(pad[:len(pad) // 2] + words + pad[len(pad) // 2:]))
    return out + [" ".join(rng.choice(filler) for _ in range(300)) for _ in range(20)]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, labels string, n_words long")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(t), (i, t)
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.base_labels) and (r.score > 0) == bool(r.labels)


def test_filters_lose_nothing_under_any_frequency():
    rng = random.Random(6)
    vocabulary = sorted({w for t in TEMPLATES.values() for w in words_of(t.encode())})
    for _ in range(5):
        a, b = (Templates(TEMPLATES, {w: rng.randrange(100) for w in vocabulary}) for _ in range(2))
        for t in texts():
            w = words_of((t or "").encode())
            assert {k: v[0] for k, v in a.matches(w).items()} == {k: v[0] for k, v in b.matches(w).items()}


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_base for r in license_scan(df).collect()) == [0, 1, 1]
    assert license_scan(df.limit(0)).count() == 0


def test_every_block_of_a_repeated_notice(spark):
    pad = " ".join(["other"] * 150)
    text = pad.join([TEMPLATES["isc"], TEMPLATES["bsd"], TEMPLATES["isc"], TEMPLATES["mit-short"], TEMPLATES["isc"]]).replace("other", " other ")
    w = brute_words(text)
    want = []
    for k, t in TEMPLATES.items():
        t = brute_words(t)
        for i in range(0, len(w), len(t)):
            both = len(set(t) & set(w[i:i + 2 * len(t)]))
            if 100 * both >= 80 * len(set(t)):
                want.append((k, i, both / len(set(t))))
    assert sum(k == "isc" for k, _, _ in want) >= 3
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert [(m.template, m.block, m.containment) for m in got[1].matches] == sorted(want)
    assert got[1].labels == "bsd,isc,mit" and got[1].score == 1.0
    assert got[2].matches == [] == got[3].matches
