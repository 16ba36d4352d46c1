"""Token counts by dynamic programming shared over a trie.

A text's pre-tokens are its words, each behind the word mark.  Distinct
pre-tokens are inserted in a trie; each node holds the forward score of its
prefix under a unigram model (the best sum of piece scores over all ways to
cut it) with the fewest pieces that reach it, worked out once from the nodes
above it.  A terminal node's piece count is the pre-token's token count, and a
text's count the sum over its words.  Nothing is shuffled: each task keeps a
trie of its own, which starts anew at ``NODES`` nodes.  Of a word of more than
``DEEP`` characters the rest is worked out by the same rule behind its node,
with the scores of the last few prefixes at hand, and kept nowhere.

The vocabulary is that of a public tokenizer (a parameter) and is not trained
here; a piece of rank r scores -ln(r + ``SHIFT``), Zipf's law.  A character
that no piece covers costs one token for each of its UTF-8 bytes.

Defined cases: null, empty and blank texts have no tokens; repeated rows and
null ids are counted one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import tables, text_or_empty

MARK = "▁"
SHIFT = 2.7
NODES = 2_000_000
DEEP = 200


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces by their rank in the file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(rank + SHIFT) for rank, i in enumerate(usable)}


class Trie:
    """Forward scores and piece counts of prefixes; ``counts`` of whole pre-tokens."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES, deep: int = DEEP):
        self.scores, self.nodes, self.deep = scores, nodes, deep
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]
        self.counts: dict[bytes, int] = {}

    def _step(self, text: str, i: int, best: Sequence[float], pieces: Sequence[int]) -> tuple[float, int]:
        """Score and pieces of text[:i + 1]; ``best`` and ``pieces`` end with those of text[:i]."""
        # A character's bytes, if no piece covers it.
        size = len(text[i].encode())
        score, count = best[-1] + self.byte * size, pieces[-1] + size
        for back in range(min(self.longest, i + 1), 0, -1):
            s = self.scores.get(text[i + 1 - back:i + 1])
            if s is not None:
                b, n = best[-back] + s, pieces[-back] + 1
                if b > score or b == score and n < count:
                    score, count = b, n
        return score, count

    def insert(self, word: bytes) -> int:
        """Tokens of a word; adds the nodes that its first ``DEEP`` prefixes lack."""
        if len(self.best) >= self.nodes:
            self.clear()
        text = MARK + word.decode("utf-8", "replace")
        node, best, pieces = 0, deque([0.0], self.longest), deque([0], self.longest)
        for i in range(min(len(text), self.deep)):
            to = self.child.get((node, text[i]))
            if to is None:
                score, count = self._step(text, i, best, pieces)
                to = self.child[node, text[i]] = len(self.best)
                self.best.append(score)
                self.pieces.append(count)
            node = to
            best.append(self.best[node])
            pieces.append(self.pieces[node])
        if len(text) <= self.deep:
            self.counts[word] = pieces[-1]
            return pieces[-1]
        for i in range(self.deep, len(text)):
            score, count = self._step(text, i, best, pieces)
            best.append(score)
            pieces.append(count)
        return pieces[-1]


def _trie(path: str) -> Trie:
    kept = tables("token_trie")
    if path not in kept:
        kept[path] = Trie(piece_scores(path))
    return kept[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path)
        for b in batches:
            words, tokens = [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                own = text.split()
                words.append(len(own))
                try:
                    tokens.append(sum(map(trie.counts.__getitem__, own)))
                except KeyError:
                    tokens.append(sum(n if (n := trie.counts.get(w)) is not None else trie.insert(w) for w in own))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             ["id", "n_words", "n_tokens"])
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: id, n_words, n_tokens."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_words long, n_tokens long"
    return rows.mapInArrow(_count(vocabulary or default_vocabulary()), schema).withColumnRenamed("id", id_col)
