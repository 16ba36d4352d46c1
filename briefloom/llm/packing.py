"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` token ids.  Pieces and the
gaps of open sequences are range-sorted by size and carry their rank among
equals, so a round is a sweep over two sorted lists: pieces in descending
order each look up their successor, the smallest gap that still holds them;
where more pieces want a gap size than there are gaps, the rank decides, and
the next ones move on to the next size.  Equal pieces fill a gap as often as
they fit.  All gaps are then updated at once and the round repeats.

Rows stay distributed: the driver sees row counts by size (at most
``capacity`` of them) and by range partition, and works out from those which
ranks meet; tasks apply that to their rows of gaps and pieces.  New sequences
are opened a round's worth at a time, for the largest pieces that no gap
holds.

Defined cases: null text is empty and gives the end id alone; repeated rows
and null ids are packed one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import stored, tables, text_or_empty

CAPACITY = 2048
END = 0
_WORDS_KEPT = 200_000  # in each of a worker's two tables
_CHUNK = 1 << 20  # bytes of texts at once
_MARKS = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
# Letters that case and normal form change one by one: of those up to U+024F all but one.
_ODD = re.compile("[\u0130\u0250-\U0010ffff]")
_LETTERS = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f\u0131-\u024f]+")
_CLOSED = re.compile("[0-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f\u0131-\u024f]\\Z")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids, as little-endian bytes, of words between ASCII white space.

    The tokenizer drops white space, ignores case and parts letters and digits
    from marks, so a text's ids are those of its words, and a word's those of
    its lower-case stem and the marks behind it.  Parts not met before are
    encoded together, as one text.

    Two tables of up to ``_WORDS_KEPT`` entries: where the newer is full it
    becomes the older, whose words move up when they are met again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # Of words that its normalizer leaves as they are; the model is the same.
        self.normal = Tokenizer(self.tokenizer.model)
        self.normal.pre_tokenizer = self.tokenizer.pre_tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, ...]:
        if b"<" in word:  # may hold a special token, which is spelt one way only
            return (word,)
        low = word.lower()
        if low.isalpha():
            return (low,)
        if not low.isascii() and not _ODD.search(text := low.decode("utf-8", "replace")):
            low = text.lower().encode()
        stem = low.rstrip(_MARKS)
        return (stem, low[len(stem):]) if stem and stem != low and _CLOSED.search(stem.decode("utf-8", "replace")) else (low,)

    def _plain(self, parts: list[bytes]) -> list[bytes]:
        """Learns parts that the normalizer leaves as they are and that hold one id that closes a word, their last; returns the others."""
        groups, rest = [parts[i:i + 200] for i in range(0, len(parts), 200)], []
        for group, got in zip(groups, self.normal.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):
                rest += group
                continue
            data, begin = ids.tobytes(), 0
            for p, end in zip(group, (4 * ends).tolist(), strict=True):
                self.new[p] = data[begin:end]
                begin = end
        return rest

    def _any(self, parts: list[bytes]) -> None:
        """Ids of any parts, told apart by their places in the joined text."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        data = np.array(got.ids, "<u4").tobytes()
        part = np.searchsorted(starts, [o[0] for o in got.offsets], "right") - 1
        begin = 0
        for p, end in zip(parts, (4 * np.searchsorted(part, np.arange(len(parts)), "right")).tolist(), strict=True):
            self.new[p] = data[begin:end]
            begin = end

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct words."""
        if len(self.new) > _WORDS_KEPT:
            self.old, self.new = self.new, {}
        new = self._moved(words)
        if new:
            plain = [w for w in new if w.isalpha() and w.islower()]
            split = {w: self.parts(w) for w in set(new).difference(plain)}
            other = self._moved(list({p for x in split.values() for p in x}.difference(plain)))
            fit = {p for p in other if _LETTERS.fullmatch(p.decode("utf-8", "replace"))}
            if rest := [*set(other).difference(fit), *self._plain([*plain, *fit])]:
                self._any(rest)
            for w, x in split.items():
                if x[0] != w:
                    self.new[w] = b"".join(map(self.new.__getitem__, x))
        return list(map(self.new.__getitem__, words))

    def _moved(self, words: list[bytes]) -> list[bytes]:
        """Those of ``words`` that neither table holds; what only the older holds moves up."""
        rest = [w for w in words if w not in self.new]
        self.new.update({w: self.old[w] for w in rest if w in self.old})
        return [w for w in rest if w not in self.old]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Of some chunk of texts each distinct word is looked up once; the rest is Arrow's and numpy's."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK, "right")))
            some = texts[at:end]
            split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(some, "<"), some, pc.ascii_lower(some)))
            coded = split.flatten().dictionary_encode()
            of = self.of(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            ids = np.frombuffer(b"".join(of), "<u4")
            lengths = np.fromiter(map(len, of), np.int64, len(of)) // 4
            starts = np.cumsum(lengths) - lengths
            code = coded.indices.to_numpy()
            n = lengths[code]
            ends = np.cumsum(n)
            got = ids[np.repeat(starts[code] - (ends - n), n) + np.arange(n.sum())].tobytes()
            last = np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
            begin = 0
            for stop in (4 * last).tolist():
                yield got[begin:stop]
                begin = stop
            at = end

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all(pa.array([text], pa.binary()).cast(pa.string())))


def _word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = tables("packing")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, data in enumerate(words.encode_all(b.column("text"))):
                data += last
                for k, i in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[i:i + 4 * capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
            out = [b.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): whole texts, cut only where longer than ``capacity``."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, end, with_ids),
                           schema + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Run:
    """Ranks [first, first + n) of a size class, each meeting ``copies`` pieces of ``length`` from rank ``piece``."""
    size: int
    first: int
    n: int
    length: int
    copies: int
    piece: int


def sweep(left: np.ndarray, placed: np.ndarray, gaps: np.ndarray) -> list[Run]:
    """One successor sweep over counts by size; updates ``left`` and ``placed``."""
    free, used, runs = gaps.copy(), np.zeros_like(gaps), []
    sizes = np.flatnonzero(free)
    for length in np.flatnonzero(left)[::-1].tolist():
        i = int(np.searchsorted(sizes, length))
        while left[length] and i < len(sizes):
            size = int(sizes[i])
            copies = size // length
            while free[size] and left[length]:
                n = int(min(free[size], max(1, left[length] // copies)))
                here = int(min(copies, left[length]))
                runs.append(Run(size, int(used[size]), n, length, here, int(placed[length])))
                free[size] -= n
                used[size] += n
                left[length] -= n * here
                placed[length] += n * here
            i += 1
        sizes = sizes[free[sizes] > 0]
    return runs


def opened(left: np.ndarray, placed: np.ndarray, capacity: int, largest_gap: int) -> list[Run]:
    """New sequences for pieces that no gap holds, the largest first.

    Pieces of more than half a sequence open one each; besides those, no more
    are opened at once than all that is left would fill.
    """
    runs, first = [], 0
    room = -(-int((left * np.arange(len(left))).sum()) // capacity)
    for length in range(int(np.flatnonzero(left).max()), largest_gap, -1):
        copies = capacity // length
        while left[length] and (copies == 1 or first < room):
            n = int(max(1, left[length] // copies))
            if copies > 1:
                n = min(n, room - first)
            here = int(min(copies, left[length]))
            runs.append(Run(capacity, first, n, length, here, int(placed[length])))
            first += n
            left[length] -= n * here
            placed[length] += n * here
    return runs


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables("pack")  # all pieces are stored: their words are done with
    at, part = 0, TaskContext.get().partitionId()
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*b.schema.names, "part", "at"])
        at += n


def _ranged(df: DataFrame, size: str, key: str, purpose: str):
    """Range-sort by (size, key).  Returns the rows with part and place, the
    counts by size, and {(part, size): what to add to a place to get the rank}."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", part int, at long"
    rows = stored(df.repartitionByRange(parts, size, key).sortWithinPartitions(size, key).mapInArrow(_numbered, schema), purpose)
    seen: dict[int, int] = {}
    add = {}
    # A size lies in one partition or in neighbours: at most sizes + partitions rows.
    for r in sorted(rows.groupBy("part", size).agg(F.count("*").alias("n"), F.min("at").alias("lo")).collect()):
        add[(r["part"], r[size])] = seen.get(r[size], 0) - r["lo"]
        seen[r[size]] = seen.get(r[size], 0) + r["n"]
    return rows, seen, add


def _ranks(b: pa.RecordBatch, size: str, add: dict) -> np.ndarray:
    s, p = b.column(size).to_numpy(), b.column("part").to_numpy()
    keys, back = np.unique(p.astype(np.int64) << 32 | s, return_inverse=True)
    return b.column("at").to_numpy() + np.array([add[(int(k) >> 32, int(k) & 0xFFFFFFFF)] for k in keys], np.int64)[back]


def _meet(runs: list[Run], add: dict):
    """Adds to rows of gaps: length, copies and first piece rank of what they take (copies 0: nothing)."""
    by_size: dict[int, list[Run]] = {}
    for r in runs:
        by_size.setdefault(r.size, []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("gap").to_numpy(), _ranks(b, "gap", add)
            length, copies, piece = (np.zeros(len(size), np.int64) for _ in range(3))
            for s in np.unique(size).tolist():
                if own := by_size.get(s):
                    rows = np.flatnonzero(size == s)
                    k = np.searchsorted([r.first for r in own], rank[rows], "right") - 1
                    inside = rank[rows] < np.array([r.first + r.n for r in own])[k]
                    rows, k = rows[inside], k[inside]
                    copies[rows] = np.array([r.copies for r in own])[k]
                    length[rows] = np.array([r.length for r in own])[k]
                    piece[rows] = np.array([r.piece for r in own])[k] + (rank[rows] - np.array([r.first for r in own])[k]) * copies[rows]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), b.column("gap"), pa.array(length), pa.array(copies), pa.array(piece)],
                                             ["sequence_id", "gap", "length", "copies", "piece"])
    return run


_MET = "sequence_id long, gap long, length long, copies long, piece long"


def _new(spark, runs: list[Run], base: int, capacity: int) -> DataFrame:
    """Rows like those of ``_meet`` for sequences opened by ``runs``."""
    firsts, fields = [r.first for r in runs], [np.array([getattr(r, f) for r in runs]) for f in ("first", "length", "copies", "piece")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("id").to_numpy()
            first, length, copies, piece = (f[np.searchsorted(firsts, at, "right") - 1] for f in fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + base), pa.array(np.full(len(at), capacity)), pa.array(length), pa.array(copies),
                 pa.array(piece + (at - first) * copies)], ["sequence_id", "gap", "length", "copies", "piece"])

    return spark.range(0, runs[-1].first + runs[-1].n).mapInArrow(run, _MET)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (stored rows with a unique long ``pid`` and ``length``) with sequence_id and offset."""
    spark = items.sparkSession
    sorted_items, counts, add = _ranged(items.select("pid", "length"), "length", "pid", "pack-items")
    left, placed = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken: list[DataFrame] = []  # rows of _meet
    gaps, base = None, 0

    def after(met: DataFrame) -> DataFrame:
        return met.select("sequence_id", (F.col("gap") - F.col("length") * F.col("copies")).alias("gap"))

    while left.any():
        least = int(np.flatnonzero(left).min())
        largest, nxt = 0, None
        if gaps is not None:
            rows, sizes, places = _ranged(gaps.where(F.col("gap") >= least), "gap", "sequence_id", "pack-gaps")
            hist = np.zeros(capacity + 1, np.int64)
            for s, n in sizes.items():
                hist[s] = n
            runs = sweep(left, placed, hist)
            if runs:
                met = rows.mapInArrow(_meet(runs, places), _MET)
                taken.append(met.where("copies > 0"))
                nxt = after(met)
                for r in runs:
                    hist[r.size] -= r.n
                    hist[r.size - r.length * r.copies] += r.n
            else:
                nxt = rows.select("sequence_id", "gap")
            largest = int(np.flatnonzero(hist).max(initial=0))
        if left.any() and (new := opened(left, placed, capacity, largest)):
            met = _new(spark, new, base, capacity)
            base += new[-1].first + new[-1].n
            taken.append(met)
            nxt = after(met) if nxt is None else nxt.unionByName(after(met))
        gaps = nxt
    if not taken:
        return items.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    all_ = taken[0]
    for t in taken[1:]:
        all_ = all_.unionByName(t)
    spots = all_.select("sequence_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"),
                        F.col("gap"), "piece").select(
        "sequence_id", "length", (F.col("piece") + F.col("k")).alias("rank"),
        (F.lit(capacity) - F.col("gap") + F.col("k") * F.col("length")).alias("offset"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("length"), pa.array(_ranks(b, "length", add))], ["pid", "length", "rank"])

    where = stored(sorted_items.mapInArrow(ranked, "pid long, length long, rank long").join(spots, ["length", "rank"])
                   .select("pid", "sequence_id", "offset"), "pack-places")
    return items.join(where, "pid")


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
             capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = stored(pieces(docs, id_col, text_col, tokenizer, capacity, end)
                   .withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return pack(items, capacity).drop("pid").withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
              capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed training rows: sequence_id, ids (at most ``capacity``)."""
    items = stored(pieces(docs, id_col, text_col, tokenizer, capacity, end, with_ids=True)
                   .withColumn("pid", F.monotonically_increasing_id()), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (pack(items, capacity).groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")))
