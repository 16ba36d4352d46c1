"""Packing: token ids against the tokenizer, and the layout of the sequences."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from briefloom.llm import common, packing
from briefloom.llm.packing import WordIds, best_fit, default_tokenizer, opened, sequences, sweep

TEXTS = ["", " \n\t", "The quick brown fox, jumped!", "á éx É", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x\x1cy z q r s",
         "ΑΣ Σ İI ŉ", "don't I'M 12 345!! ??.. a.b,c ...", "a\x00b ퟿ 漢字 😀", "!!!", "Übergröße. ÜBER, é.", "ö ̈o", "'s 'S it's"]


@pytest.mark.parametrize("kept", [1_000_000, 4])
def test_ids_equal_the_tokenizers(monkeypatch, kept):
    monkeypatch.setattr(packing, "_WORDS_KEPT", kept)
    words = WordIds(default_tokenizer())
    for _ in range(2):
        for t in TEXTS:
            want = words.tokenizer.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(words.encode(t.encode()), "<u4").tolist() == want, t


def test_letters_of_any_case_and_marks_take_the_short_path(monkeypatch):
    words, slow = WordIds(default_tokenizer()), []
    any_ = words._any
    monkeypatch.setattr(words, "_any", lambda parts: (slow.extend(parts), any_(parts)))
    odd = ["ÉÊen,%%% Äpf,*** ciónñ élan", "İ,, ŉ' a…, ½, a=\u0338 é'", "x's, Γεια, ǅ! <é, ºª; é\u0301,", "<|endoftext|> É <|ENDOFTEXT|>, B,%%%"]
    for text in odd + TEXTS:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert not {w.encode() for w in ("éêen", "äpf", "ciónñ", "élan", "b")} & set(slow)
    assert not any(p.endswith(b"%%%") and p[:1].isalpha() for p in slow)


def test_a_worker_keeps_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(packing, "_WORDS_KEPT", 100)
    monkeypatch.setattr(packing, "_CHUNK", 200)
    words = WordIds(default_tokenizer())
    texts = [f"word{i} again other{i % 7}, Mark{i}!?" for i in range(1000)]
    for got, text in zip(words.encode_all(pa.array(texts)), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words.new) + len(words.old) < 400


def test_words_are_dropped_when_the_pieces_are_stored(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    common.tables("packing")["a tokenizer"] = "its words"
    assert list(packing._numbered(iter([]))) == []
    assert "packing" not in common._TABLES


def test_layout_and_checksums(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(int(2 ** rng.uniform(0, 12.5))))) for i in range(300)]
    rows += [(300, None), (301, ""), (301, ""), (None, "a b c"), *((400 + i, "same length text") for i in range(200))]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    got = best_fit(df).collect()
    tok = WordIds(default_tokenizer()).tokenizer
    ids = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    want = sorted(((i, k // 2048, k, len(x[k:k + 2048]), zlib.crc32(np.array(x[k:k + 2048], "<u4").tobytes()))
                   for i, t in rows for x in [ids[i, t]] for k in range(0, len(x), 2048)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= 1.02 * total / 2048 + 2
    assert sum(len(r.ids) for r in sequences(df).collect()) == total
    assert best_fit(df.limit(0)).count() == 0


def test_sweeps_place_every_piece_within_its_gap():
    rng = np.random.default_rng(2)
    for _ in range(30):
        cap = 64
        left = rng.integers(0, 30, cap + 1)
        left[0] = 0
        want, total = left.copy(), int((left * np.arange(cap + 1)).sum())
        placed, hist, n = np.zeros_like(left), np.zeros_like(left), 0
        while left.any():
            runs = sweep(left, placed, hist) if n else []
            for r in runs:
                assert 0 < r.length * r.copies <= r.size
                hist[r.size] -= r.n
                hist[r.size - r.length * r.copies] += r.n
            assert (hist >= 0).all()
            if left.any():
                new = opened(left, placed, cap, int(np.flatnonzero(hist).max(initial=0)))
                n += sum(r.n for r in new)
                for r in new:
                    hist[cap - r.length * r.copies] += r.n
        assert (placed == want).all() and n >= total / cap and (hist * np.arange(cap + 1)).sum() == n * cap - total
