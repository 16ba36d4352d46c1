"""Token counts against all segmentations."""

import random

from briefloom.llm.common import tables
from briefloom.llm.token_trie import MARK, Trie, default_vocabulary, piece_scores, token_counts


def brute(text, scores, byte):
    """(score, -count) of the best cut, by trying each first piece left to right."""
    best = None

    def walk(at, score, count):
        nonlocal best
        if at == len(text):
            best = max(best, (score, -count)) if best else (score, -count)
            return
        size = len(text[at].encode())
        walk(at + 1, score + byte * size, count + size)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in scores:
                walk(end, score + scores[text[at:end]], count + 1)

    walk(0, 0.0, 0)
    return -best[1]


def test_equals_all_segmentations():
    rng = random.Random(1)
    scores = {MARK: -1.5} | {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 4))): -rng.random() * 4 for _ in range(14)}
    trie, small, flat = Trie(scores), Trie(scores, nodes=20), Trie(scores, deep=3)
    for _ in range(400):
        w = "".join(rng.choice("abéz漢") for _ in range(rng.randrange(1, 8))).encode()
        want = brute(MARK + w.decode(), scores, trie.byte)
        assert trie.insert(w) == want and trie.insert(w) == want and small.insert(w) == want
        assert flat.insert(w) == want
        assert len(MARK + w.decode()) <= 3 or w not in flat.counts


def test_a_long_word_leaves_no_more_than_its_first_prefixes():
    rng = random.Random(2)
    scores = piece_scores(default_vocabulary())
    word = "".join(rng.choice("abcdefgh") for _ in range(200_000)).encode()
    trie, deep = Trie(scores), Trie(scores, deep=300_000)
    assert trie.insert(word) == deep.insert(word) == trie.insert(word)
    assert len(trie.best) == len(trie.child) + 1 == trie.deep + 1 and not trie.counts


def test_documents(spark):
    scores = piece_scores(default_vocabulary())
    fresh = lambda w: Trie(scores).insert(w.encode())
    words = ["the", "thanea", "Über", "漢", "a" * 300, "x.y,z", " "]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, None), (3, ""), (4, " \t\n"), (None, "the\x0bthe"), (6, "the " * 20_000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in token_counts(df).collect()), key=str)
    total = sum(map(fresh, words))
    assert got == sorted([(1, 7, total), (1, 7, total), (2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 2, 2 * fresh("the")),
                          (6, 20_000, 20_000 * fresh("the"))], key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_a_worker_keeps_the_tables_of_one_operator():
    one = tables("one")
    one["x"] = 1
    assert tables("one") is one
    assert tables("two") == {} and tables("one") == {}
