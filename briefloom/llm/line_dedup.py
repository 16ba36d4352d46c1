"""Line dedup by a segment-partition edit join.

Lines of at least ``min_chars`` code points that are equal or near each
other, directly or over further lines, are one class; of a class the first
line by (document key, place) stays and all others go.  Shorter lines are
never touched.  Two lines are near within ``edits`` character edits, or
within one word edit for every ``SHARE`` words of the longer one.  A word
(token) is a run of characters without white space; of scripts that put no
blanks between words each character is one.

Candidates, from keys of each line alone, lose no near pair:

* A line's segments are each two tokens in a row; the same segment again is
  one of its own.  ``k`` token edits spoil at most ``2 * k`` segments, a character
  edit three (four, where characters are words).  So of any one segment more than
  edits can spoil, one is in the other line as well.  In an order that holds for
  all lines, the first so many segments of each are its keys: the smallest
  segment that two near lines share is among the first of both.  Frequent
  segments are last in that order, so what many lines hold joins few of them.
* Lines of so few tokens that edits may spoil every segment: each is cut into
  ``edits + 1`` even segments of its characters.  A line within that many edits of
  it must hold one of them unchanged, at a place that the two lengths and the
  edits allow; so each such line probes the segment index of its own and the
  next smaller lengths with just those substrings.  Of a pair with one longer
  line, that line's two-token segments are enough.

Keys that two lines share give the candidate pairs, if their lengths, their counts
of tokens and the parities of these counts by bin allow it.  Each line meets the
first such line of its groups; what those links join is not compared again.  Of
groups of up to ``GROUP`` lines those that further pairs leave open meet again with
their texts, a pair in the first open group of both alone; larger groups are cut
by token counts and then compared block against block.  Both are done inside tasks,
which return verified links alone, none between what they have joined already: of
pairs that are no links only first ones are rows, one a line and key at most.  Links are verified by banded bit-parallel
edit distance.

Defined cases: null and empty texts have no lines and stay as they are;
repeated rows and null ids are rows of their own, in the order of
``common.keyed``; equal lines within one document count as well; an empty
table gives an empty result; other columns are passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import components, keyed, partitions, stored, tables, text_or_empty, with_texts

EDITS = 2
MIN_CHARS = 20
GROUP = 512
BLOCK = 256
SHARE = 10  # tokens for each token edit
_BINS, _WIDE = 64, 2048
_WORDS = 4
_MOST = 32767
_BASE = 0x9E3779B97F4A7C15
_ROWS = 1 << 12  # lines at once
_CHUNK = 1 << 18  # characters at once
_BLOCK = {"k": np.int64, "lid": np.int64, "tokens": np.int32, "size": np.int8, "odd0": np.uint64, "odd1": np.uint64}
_MET = ["k", "a", "b", "tokens", "indexed", "size", "odd0", "odd1", "n"]
_OPEN = ["k", "lid", "label", "tokens", "size", "odd0", "odd1"]
_AT_ONCE = 1 << 18  # keys of a task that are dealt together
_SLOTS = 1 << 20  # of counts of segments
_SAMPLED = 32
_FREQUENT = 50_000
_APART = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\s{_APART}]+|\S")


def _stripped(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """a and b without what they have in common at both ends: it never needs an edit."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # slices are compared at once
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid:len(a) - lo] == b[len(b) - mid:len(b) - lo] else (lo, mid - 1)
    return a[:len(a) - lo], b[:len(b) - lo]


def _few(a: Sequence, b: Sequence) -> bool:
    """Whether two edits make b of a; neither their first nor their last places are equal.

    So one edit is at the start and one at the end, and all between is the same.
    """
    if max(len(a), len(b)) <= 2:
        return True
    for i, j in ((1, 1), (1, 0), (0, 1)):
        for x, y in ((1, 1), (1, 0), (0, 1)):
            if len(a) - i - x == len(b) - j - y >= 0 and a[i:len(a) - x] == b[j:len(b) - y]:
                return True
    return False


def within(a: Sequence, b: Sequence, edits: int) -> bool:
    """Whether the edit distance of a and b is at most ``edits``.

    Bit-parallel over the diagonals: bit d of row e is set when e edits can
    align the prefixes read so far on diagonal d, within the band.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    a, b = _stripped(a, b)
    if not a or not b:
        return max(len(a), len(b)) <= edits
    if edits <= 2:
        return _few(a, b) if edits == 2 else max(len(a), len(b)) <= edits
    # Banded automaton: bit j of state[e]: a[:i] matches b[:i - edits + j] with e edits.
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j + edits
    state = [((1 << e + 1) - 1) << edits & full for e in range(edits + 1)]
    for i, c in enumerate(a):
        hit = where.get(c, 0) >> i & full  # bit j: b[i - edits + j] == c
        before = state
        state = [before[0] & hit]
        for e in range(1, edits + 1):
            last = before[e - 1]
            now = (before[e] & hit) | last | last >> 1  # match, replace, drop a's character
            now |= state[e - 1] << 1  # take b's character
            state.append(now & full)
        # Places before b's start or behind its end do not exist.
        low = max(0, edits - i - 1)
        high = len(b) - (i + 1) + edits
        valid = full >> low << low & ((1 << max(0, high + 1)) - 1 if high < width else full)
        state = [s & valid for s in state]
        if not state[-1]:
            return False
    end = len(b) - len(a) + edits
    return bool(state[-1] >> end & 1)


def within_tokens(a: list[str], b: list[str], edits: int) -> bool:
    """The same for many edits: bit-parallel over the whole of b, whose bits are one number."""
    if edits <= 2:
        return within(a, b, edits)
    a, b = _stripped(a, b)
    if not a or not b:
        return max(len(a), len(b)) <= edits
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    full, last, score = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    up, down = full, 0
    for i, c in enumerate(a, 1):
        hit = where.get(c, 0)
        across = ((hit & up) + up ^ up | hit) & full
        more, less = down | full & ~(across | up), up & across
        score += bool(more & last) - bool(less & last)
        if score - (len(a) - i) > edits:
            return False
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(hit | down | more), more & (hit | down)
    return score <= edits


def tokens_of(line: str) -> list[str]:
    try:
        line.isascii() or line.encode("latin-1")  # no scripts without blanks
    except UnicodeEncodeError:
        return _TOKEN.findall(line)
    return line.split()


def near(a: str, b: str, edits: int) -> bool:
    """Whether a and b are within ``edits`` character edits or their share of token edits."""
    if within(a, b, edits):
        return True
    x, y = tokens_of(a), tokens_of(b)
    n = max(len(x), len(y))
    k = n // SHARE
    return bool(k) and abs(len(x) - len(y)) <= k and (k <= 2 or (Counter(x) & Counter(y)).total() >= n - k) and within_tokens(x, y, k)


def near_tokens(a: str, b: str, x: list, y: list, edits: int, counts: tuple[Counter, Counter] | None = None) -> bool:
    """``near`` of lines whose tokens are at hand, with their ``counts`` or of about the same."""
    if abs(len(a) - len(b)) <= edits and within(a, b, edits):
        return True
    n = max(len(x), len(y))
    k = n // SHARE
    if not k or abs(len(x) - len(y)) > k or k > 2 and counts and (counts[0] & counts[1]).total() < n - k:
        return False
    return within_tokens(x, y, k)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the even segments of a line of n characters."""
    parts, out, at = edits + 1, [], 0
    for i in range(parts):
        size = n // parts + (i >= parts - n % parts)
        out.append((at, size))
        at += size
    return out


def probes(n: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(line length, segment, start, size) that a line of n characters looks up."""
    out = []
    for length in range(max(1, n - edits), n + 1):
        d = n - length
        for i, (p, size) in enumerate(segments(length, edits)):
            lo = max(0, p - i, p + d - (edits - i))
            hi = min(n - size, p + i, p + d + (edits - i))
            out += [(length, i, start, size) for start in range(lo, hi + 1) if (d, start) != (0, p)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 a character of a word, 2 one that is a word by itself."""
    out = np.ones(0x110000, np.uint8)
    out[[c for c in range(0x3100) if chr(c).isspace()]] = 0
    ends = [ord(c) for c in _APART.replace("-", "")]
    for lo, hi in zip(ends[::2], ends[1::2], strict=True):
        out[lo:hi + 1] = np.minimum(out[lo:hi + 1], 1) * 2
    return out


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, for the places of a chunk."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        each = np.full(_CHUNK + 1, b, np.uint64)
        each[0] = 1
        out.append(np.cumprod(each))
    return out[0], out[1]


def _token_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash) of each token of some lines, and of each line whether characters of it stand for themselves."""
    text = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(text) > _CHUNK and len(lines) > 1:
        half = len(lines) // 2
        (r1, h1, a1), (r2, h2, a2) = _token_hashes(lines[:half]), _token_hashes(lines[half:])
        return np.concatenate([r1, r2 + half]), np.concatenate([h1, h2]), np.concatenate([a1, a2])
    kind = _kinds()[text]
    apart = kind == 2
    inside = kind != 0
    start = inside.copy()
    start[1:] &= apart[1:] | apart[:-1] | ~inside[:-1]
    end = inside.copy()
    end[:-1] &= apart[:-1] | apart[1:] | ~inside[1:]  # the last character is a line's end
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    powers, inverse = _powers()
    hashes = np.zeros(len(start), np.uint64)
    for o in range(0, len(text), _CHUNK):  # more than one chunk: a single line
        part = text[o:o + _CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint32(1)) * powers[:len(part)], out=sums[1:])
        i, j = int(np.searchsorted(end, o, "right")), int(np.searchsorted(start, o + len(part)))
        own = sums[np.minimum(end[i:j] - o, len(part))] - sums[np.maximum(start[i:j] - o, 0)]
        own *= inverse[np.maximum(start[i:j] - o, 0)]
        if i < j and start[i] < o:  # begun in a chunk before
            own[:1] *= np.uint64(pow(_BASE, int(o - start[i]), 1 << 64))
        hashes[i:j] += own
    odd = np.bincount(np.searchsorted(ends, np.flatnonzero(apart), "right"), minlength=len(lines)) > 0
    return np.searchsorted(ends, start, "right"), _mixed(hashes), odd


def _grams(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each two tokens in a row."""
    both = row[1:] == row[:-1]
    return row[1:][both], _mixed(token[:-1] * np.uint64(0x100000001B3) + token[1:])[both]


def _parities(row: np.ndarray, token: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line 128 bits: whether the number of its tokens in a bin is odd."""
    full = np.flatnonzero(width)
    starts = (np.cumsum(width) - width)[full]
    out = np.zeros((2, len(width)), np.uint64)
    if len(full):
        bit, high = np.uint64(1) << (token >> np.uint64(58)), token >> np.uint64(57) & np.uint64(1)
        for i in (0, 1):
            out[i][full] = np.bitwise_xor.reduceat(np.where(high == i, bit, np.uint64(0)), starts)
    return out[0], out[1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often segments fall in each slot."""
    tables("line_dedup")
    n = np.zeros(_SLOTS, np.int64)
    for b in batches:
        lines = b.column("line").to_pylist()
        for i in range(0, len(lines), _ROWS):
            gram = _grams(*_token_hashes(lines[i:i + _ROWS])[:2])[1]
            n += np.bincount((gram % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS)
    slot = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[slot])], ["slot", "n"])


def frequent(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of frequent segments and the place of each in the order of segments.

    From one line in ``_SAMPLED``. Any order finds every near pair; in this one fewer others meet.
    """
    some = lines.select("line").where(F.pmod(F.xxhash64("line", F.lit(3)), F.lit(_SAMPLED)) == 0)
    top = (some.mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 2")
           .orderBy(F.desc("n"), "slot").limit(_FREQUENT).toPandas())
    return top["slot"].to_numpy(np.int64), np.minimum(255, 8 * np.log2(top["n"].to_numpy(np.float64))).astype(np.uint8)


def _keys(edits: int, slots: tuple[np.ndarray, np.ndarray] | None = None):
    digest = xxhash.xxh3_64_intdigest

    def plan(n: int) -> tuple[list, list]:
        seed = lambda length, i: (length * (edits + 1) + i) * 8
        return ([(p, p + size, seed(n, i)) for i, (p, size) in enumerate(segments(n, edits))],
                [(p, p + size, seed(length, i)) for length, i, p, size in probes(n, edits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables("line_dedup")
        plans: dict[int, tuple[list, list]] = {}
        order = np.zeros(_SLOTS, np.uint8)
        if slots is not None:
            order[slots[0]] = slots[1]

        for b in batches:
            lids, lines = b.column("lid").to_numpy(), b.column("line").to_pylist()
            for at in range(0, len(lines), _ROWS):
                some = lines[at:at + _ROWS]
                row, token, apart = _token_hashes(some)
                width = np.bincount(row, minlength=len(some))
                odd = _parities(row, token, width)
                # Lengths modulo 256: two that differ by a few do so there as well.
                size = np.fromiter(map(len, some), np.int64, len(some)).astype(np.uint8).view(np.int8)
                row, gram = _grams(row, token)
                # A line's segments, the least frequent first.
                value = order[(gram % np.uint64(_SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(42) | gram >> np.uint64(22)
                value = np.sort(row.astype(np.uint64) << np.uint64(50) | value)
                row = (value >> np.uint64(50)).astype(np.int64)
                first = np.searchsorted(row, np.arange(len(some)))
                spoilt = np.where(apart, 4, 3) * edits
                taken = 1 + np.maximum(spoilt, 2 * (width // SHARE) + (width % SHARE == SHARE - 1))
                place = np.arange(len(row))
                # The same segment again is one of its own, by its number.
                again = np.zeros(len(row), np.int64)
                again[1:] = value[1:] == value[:-1]
                if again.any():
                    again = place - np.maximum.accumulate(np.where(again == 0, place, 0))
                take = place - first[row] < taken[row]
                row, value, again = row[take], value[take], again[take].astype(np.uint64)
                key = _mixed((value & np.uint64((1 << 50) - 1)) * np.uint64(0x100000001B3) + again)
                # Lines of so few segments that edits may spoil all: by parts of their characters.
                keys, owner, indexed = [], [], []
                for i in np.flatnonzero(width - 1 <= spoilt).tolist():
                    line = some[i]
                    if len(line) not in plans:
                        if len(plans) > 100_000:
                            plans.clear()
                        plans[len(line)] = plan(len(line))
                    cut, look = plans[len(line)]
                    own = {digest(line[p:q], seed) for p, q, seed in cut}
                    found = {digest(line[p:q], seed) for p, q, seed in look} - own
                    keys += [*own, *found]
                    owner += [i] * (len(own) + len(found))
                    indexed += [True] * len(own) + [False] * len(found)
                key = np.concatenate([key, np.array(keys, np.uint64)])
                row = np.concatenate([row, np.array(owner, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(lids[at + row]), pa.array(width[row].astype(np.int32)),
                     pa.array(np.concatenate([np.ones(len(key) - len(keys), bool), np.array(indexed, bool)])),
                     pa.array(size[row]), *(pa.array(x[row].view(np.int64)) for x in odd)],
                    ["k", "lid", "tokens", "indexed", "size", "odd0", "odd1"])
    return run


def _dealt(keys, buckets: int):
    """Rows of keys as blocks of bytes, one for each bucket and _AT_ONCE keys of a task: they move for little."""
    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        k, lid, tokens, indexed, size, *odd = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(7))
        bucket = (_mixed(k.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        ids, starts = np.unique(bucket[by], return_index=True)
        data = k[by], lid[by], tokens[by].astype(np.int32) * 2 + indexed[by], size[by], odd[0][by], odd[1][by]
        ends = [*starts[1:].tolist(), len(by)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), *(pa.array([x[p:q].tobytes() for p, q in zip(starts.tolist(), ends, strict=True)], pa.binary()) for x in data)],
            ["bucket", *_BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in keys(batches):
            held.append(b)
            n += b.num_rows
            if n >= _AT_ONCE:
                yield blocks(held)
                held, n = [], 0
        if n:
            yield blocks(held)
    return run


def _like(k: np.ndarray, tokens: np.ndarray, size: np.ndarray, odd: list[np.ndarray], x: np.ndarray, edits: int,
          most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y), at most ``most`` apart, of lines of one key that may be near; for rows sorted by key, the nearest places first.

    A token edit changes the count of tokens by one at most and two parities, a character edit two and four and the length by one.
    """
    d = 0
    while len(x) and d < most:
        d += 1
        x = x[x + d < len(k)]
        x = x[k[x] == k[x + d]]
        y = x + d
        words = np.maximum(tokens[x], tokens[y]) // SHARE
        chars = np.abs(size[x] - size[y]) <= edits
        ok = (chars | (words > 0)) & (np.abs(tokens[x] - tokens[y]) <= np.where(chars, np.maximum(2 * edits, words), words))
        ok &= sum(np.bitwise_count(o[x] ^ o[y]).astype(np.int64) for o in odd) <= np.where(chars, np.maximum(4 * edits, 2 * words), 2 * words)
        yield x[ok], y[ok]


def _met(edits: int, group: int):
    """Of each bucket's keys those that lines share.

    As pairs (a, b) of each line and the first before it (of the last ``group``) that it may be near; as rows
    (k, a, ...) the lines of further pairs, and all where there are more than ``group``.
    """
    def of(blocks: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        k, lid, tokens, size, *odd = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*blocks, strict=True), _BLOCK.values(), strict=True))
        by = np.lexsort((tokens, lid, k))
        last = np.ones(len(by), bool)  # a line has a key once
        last[:-1] = (k[by][1:] != k[by][:-1]) | (lid[by][1:] != lid[by][:-1])
        by = by[last]
        starts = np.flatnonzero(np.concatenate([[True], k[by][1:] != k[by][:-1]]))
        sizes = np.diff(np.append(starts, len(by)))
        met = np.logical_or.reduceat((tokens[by] & 1).astype(bool), starts) & (sizes > 1)
        by, sizes = by[np.repeat(met, sizes)], sizes[met]
        k, lid, indexed, tokens, size, odd = k[by], lid[by], tokens[by] & 1 > 0, tokens[by].astype(np.int64) >> 1, size[by], [x[by] for x in odd]
        of_size = np.repeat(sizes, sizes)
        first, more = np.full(len(k), -1), of_size > group
        for x, y in _like(k, tokens, size, odd, np.arange(len(k)), edits, group):
            ok = indexed[x] | indexed[y]
            x, y = x[ok], y[ok]
            again = y[first[y] >= 0]
            more[again] = more[first[again]] = True
            first[y] = x
        y = np.flatnonzero(first >= 0)
        pairs = np.unique(np.stack([lid[first[y]], lid[y]], 1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none.cast(pa.int32()), none.cast(pa.bool_()),
                                          none.cast(pa.int8()), none, none, none], _MET)
        if more.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[more]), pa.array(lid[more]), pa.nulls(int(more.sum()), pa.int64()), pa.array(tokens[more].astype(np.int32)),
                 pa.array(indexed[more]), pa.array(size[more]), *(pa.array(x[more].view(np.int64)) for x in odd), pa.array(of_size[more])], _MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for i, *block in zip(*(b.column(c).to_pylist() for c in ("bucket", *_BLOCK)), strict=True):
                if i != bucket and held:
                    yield from of(held)
                    held = []
                bucket = i
                held.append(block)
        if held:
            yield from of(held)
    return run


def _by_key(of):
    """``of`` over batches of whole keys; rows are sorted by ``k``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, held = of(), []
        for b in batches:
            if b.num_rows == 0:
                continue
            k = b.column("k").to_numpy()
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
            if held and (cut or held[0].column("k")[0].as_py() != k[0]):
                yield each([*held, b.slice(0, cut)])
                held = []
            elif cut:
                yield each([b.slice(0, cut)])
            held.append(b.slice(cut))
        if held:
            yield each(held)
    return run


def _column(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in rows])


def _open(edits: int):
    """Lines that may be near another one of their key and are not of one label with it yet."""
    def of():
        def each(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            k, lid, label, tokens, size, *odd = columns = [_column(rows, c) for c in _OPEN]
            indexed = _column(rows, "indexed")
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            apart = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            x = np.flatnonzero(np.repeat(apart, np.diff(np.append(starts, len(k)))))
            left = np.zeros(len(k), bool)
            for x, y in _like(k, tokens.astype(np.int64), size, [o.view(np.uint64) for o in odd], x, edits, len(k)):
                new = (label[x] != label[y]) & (indexed[x] | indexed[y])
                left[x[new]] = left[y[new]] = True
            return pa.RecordBatch.from_arrays([pa.array(c[left]) for c in columns], _OPEN)
        return each
    return _by_key(of)


def _before(k: np.ndarray, at: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """Of each row, as bits, which keys below its own its line has, of those that most lines of its group have.

    ``key`` are the keys of the rows ``at``. Two lines of a group with a bit in common have met in an earlier group.
    """
    out = [np.zeros(len(k), np.uint64) for _ in range(_WORDS)]
    below = key < k[at]
    at, key = at[below], key[below]
    if not len(at):
        return out
    by = np.lexsort((key, k[at]))
    at, key, group = at[by], key[by], k[at][by]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
    sizes = np.diff(np.append(starts, len(at)))
    by = np.lexsort((-sizes, group[starts]))
    first = group[starts][by]
    first = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    place = np.repeat(np.where(sizes > 1, place, 64 * _WORDS), sizes)
    for i, word in enumerate(out):
        own = place >> 6 == i
        np.bitwise_or.at(word, at[own], np.uint64(1) << (place[own] & 63).astype(np.uint64))
    return out


def _compared(edits: int):
    """Verified links (a, b) of open lines; each pair is compared in the first of the keys that both have."""
    def of():
        up: dict[int, int] = {}  # of labels that links of this task have joined

        def top(v: int) -> int:
            while (over := up.get(v, v)) != v:
                up[v] = v = up.get(over, over)
            return v

        def each(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            k, lid, label, tokens, size, *odd = (_column(rows, c) for c in _OPEN)
            lines, keys = (pa.chunked_array([b.column(c) for b in rows]) for c in ("line", "keys"))
            held: dict[int, tuple[str, list, Counter, set]] = {}
            of = pa.chunked_array([b.column("keys") for b in rows]).combine_chunks()
            before = _before(k, np.repeat(np.arange(len(k)), pc.list_value_length(of).to_numpy()), of.flatten().to_numpy())

            def row(i: int) -> tuple[str, list, Counter, set]:
                if (found := held.get(lid[i])) is None:
                    line = lines[i].as_py()
                    cut = tokens_of(line)
                    held[lid[i]] = found = line, cut, Counter(cut), set(keys[i].as_py())
                return found

            links = [np.empty((0, 2), np.int64)]
            for x, y in _like(k, tokens.astype(np.int64), size, [o.view(np.uint64) for o in odd], np.arange(len(k)), edits, len(k)):
                new = label[x] != label[y]
                for word in before:
                    new &= word[x] & word[y] == 0
                for i, j in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    one, other = top(int(label[i])), top(int(label[j]))
                    if one == other:
                        continue
                    (a, own, n, mine), (b, others, m, its) = row(i), row(j)
                    if min(mine & its) == k[i] and near_tokens(a, b, own, others, edits, (n, m)):
                        up[other] = one
                        links.append(np.sort(lid[[i, j]])[None])
            a, b = np.concatenate(links).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return each
    return _by_key(of)


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [near(x, y, edits) for x, y in zip(b.column("line_a").to_pylist(), b.column("line_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _bins(n: int, row: np.ndarray, token: np.ndarray, bins: int) -> np.ndarray:
    """Of each of n lines, how many of its tokens fall in each bin."""
    out = np.bincount(row * bins + (token % np.uint64(bins)).astype(np.int64), minlength=n * bins)
    return np.minimum(out, _MOST).reshape(-1, bins).astype(np.int16)


def _blocks(edits: int):
    """One pair of blocks of a group: a token edit changes at most two token counts by one, a character edit four.

    Lines that share further large groups are compared in the first of these alone.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=["a", "b"], dtype="int64")
        if group["label"].nunique() == 1:
            return none
        k = int(group["k"].iloc[0])
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        same = len(right) == 0
        right = left if same else right
        group_of = {lid: lid for lid in group["label"]} | dict(zip(group["lid"], group["label"], strict=True))

        def top(v: int) -> int:
            while group_of[v] != v:
                group_of[v] = v = group_of[group_of[v]]
            return v

        def columns(df: pd.DataFrame) -> list[np.ndarray]:
            return [df[c].to_numpy(t) for c, t in (("label", np.int64), ("tokens", np.int64), ("size", np.int8),
                                                   ("odd0", np.int64), ("odd1", np.int64))]

        # Cheapest first: labels, counts of tokens and their parities by bin, as in _like, and earlier groups.
        lists = [*left["keys"], *([] if same else right["keys"])]
        before = _before(np.full(len(lists), k), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists))
        label, n, size, *odd = columns(right)
        met: dict[int, np.ndarray] = {}
        for i, (own, m, chars, *mine) in enumerate(zip(*columns(left), strict=True)):
            words, few = np.maximum(n, m) // SHARE, np.abs(size - chars) <= edits
            ok = (label != own) & (few | (words > 0)) & (np.abs(n - m) <= np.where(few, np.maximum(2 * edits, words), words))
            ok &= (sum(np.bitwise_count((o ^ x).view(np.uint64)).astype(np.int64) for o, x in zip(odd, mine, strict=True))
                   <= np.where(few, np.maximum(4 * edits, 2 * words), 2 * words))
            for word in before:
                ok &= word[-len(right):] & word[i] == 0
            if same:
                ok[:i + 1] = False
            if ok.any():
                met[i] = np.flatnonzero(ok)
        if not met:
            return none

        def cut(df: pd.DataFrame, used: list[int]) -> tuple[dict[int, tuple[str, list[str], set]], np.ndarray, np.ndarray, np.ndarray]:
            some = df.iloc[used]
            rows = [(line, tokens_of(line), set(keys)) for line, keys in zip(some["line"], some["keys"], strict=True)]
            place = np.zeros(len(df), np.int64)
            place[used] = np.arange(len(used))
            row, token, _ = _token_hashes([r[0] for r in rows])
            return dict(zip(used, rows, strict=True)), place, *(_bins(len(rows), row, token, b) for b in (_BINS, _WIDE))

        used = sorted({*met, *np.concatenate(list(met.values())).tolist()}) if same else sorted(met)
        mine, at, x, wide_x = cut(left, used)
        others, to, y, wide_y = (mine, at, x, wide_x) if same else cut(right, np.unique(np.concatenate(list(met.values()))).tolist())
        lids, out = right["lid"].tolist(), []
        for (i, j), lid, chars in zip(met.items(), left["lid"].iloc[list(met)].tolist(), left["size"].iloc[list(met)].to_numpy(np.int8), strict=True):
            line, tokens, keys = mine[i]
            words = 2 * (np.maximum(n[j], len(tokens)) // SHARE)
            most = np.where(np.abs(size[j] - chars) <= edits, np.maximum(4 * edits, words), words)
            for narrow, own in ((y, x[at[i]]), (wide_y, wide_x[at[i]])):
                ok = np.abs(narrow[to[j]].astype(np.int32) - own).sum(axis=1, dtype=np.int64) <= most
                j, most = j[ok], most[ok]
            for j in j.tolist():
                other_line, other_tokens, its = others[j]
                # What further lines connect already needs no link of its own.
                if (one := top(lid)) != (other := top(lids[j])) and min(keys & its) == k and near_tokens(line, other_line, tokens, other_tokens, edits):
                    group_of[one] = other
                    out.append((min(lid, lids[j]), max(lid, lids[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _lengths(edits: int) -> Column:
    """Ranges of token counts: two lines that may be near are in the same or in neighbouring ones."""
    n, step = F.col("tokens").cast("double"), 2 * edits
    even = float(step * SHARE)
    ratio = SHARE / (SHARE - 1) * 1.001  # rounding
    return F.floor(F.when(n < even, n / step).otherwise(even / step + F.log(n / even) / F.log(F.lit(ratio)))) if step else F.floor(
        F.log(F.greatest(n, F.lit(1.0))) / F.log(F.lit(ratio)))


def line_links(lines: DataFrame, edits: int = EDITS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(lid, label) of those stored distinct lines (lid, line) that verified links connect; the label is the smallest such lid."""
    lines = lines.select("lid", "line")
    parts = partitions(lines.sparkSession)
    # Most keys are met once: they move once, in blocks, and no further than to the sort that shows it.
    met = stored(lines.mapInArrow(_dealt(_keys(edits, frequent(lines)), 4 * parts), "bucket int, " + ", ".join(f"{c} binary" for c in _BLOCK))
                 .repartition(parts, "bucket").sortWithinPartitions("bucket")
                 .mapInArrow(_met(edits, group), "k long, a long, b long, tokens int, indexed boolean, size byte, odd0 long, odd1 long, n long"), "line-met")
    rows = met.where(F.col("k").isNotNull()).withColumnRenamed("a", "lid")
    # Larger groups are cut by counts of tokens: each line is in its own range and meets the range below.
    cut = stored(rows.where(F.col("n") > group).withColumn("range", _lengths(edits))
                 .withColumn("range", F.explode(F.array("range", F.col("range") + 1)))
                 .select(F.xxhash64("k", "range").alias("k"), "lid", "tokens", "indexed", "size", "odd0", "odd1").distinct(), "line-cut")
    # Of groups of the same lines one is enough.
    of = (cut.groupBy("k").agg(F.count("*").alias("n"), F.max("indexed").alias("any"), F.min("indexed").alias("all"),
                               F.sum(F.xxhash64("lid").cast("decimal(20,0)")).alias("s1"),
                               F.sum(F.xxhash64("lid", F.lit(1)).cast("decimal(20,0)")).alias("s2"))
          .where("n > 1 and any").groupBy("n", "all", "s1", "s2", F.when(~F.col("all"), F.col("k")).alias("own")).agg(F.min("k").alias("k")))
    counted = cut.join(of.select("k", "n"), "k")
    # What is still larger: every block of at most about ``block`` lines meets every other once.
    large = stored(counted.where(F.col("n") > group).select("k", "lid", "n", "tokens", "size", "odd0", "odd1").distinct(), "line-large")
    # Each line and the first that it may be near: what these links join needs no further comparison.
    pairs = stored(met.where(F.col("b").isNotNull()).select("a", "b").distinct(), "line-pairs")
    # Only lines of some group are compared: their texts move once, not in every join.
    grouped = pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).union(rows.select("lid")).distinct()
    text = stored(with_texts(lines).join(grouped, "lid", "left_semi"), "line-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return (pairs.join(text.select(F.col("lid").alias("a"), F.col("line").alias("line_a")), "a")
                .join(text.select(F.col("lid").alias("b"), F.col("line").alias("line_b")), "b")
                .mapInArrow(_verified(edits), "a long, b long"))

    first = stored(verified(pairs), "line-links")
    known = components(first)
    labels = known.withColumnRenamed("v", "lid")
    labelled = lambda df: df.join(labels, "lid", "left").withColumn("label", F.coalesce("label", "lid"))
    kept = ["k", "lid", "tokens", "indexed", "size", "odd0", "odd1"]
    more = labelled(rows.where(F.col("n") <= group).select(kept).unionByName(counted.where(F.col("n") <= group).select(kept)))
    left = stored(more.select(*kept, "label").repartition(parts, "k").sortWithinPartitions("k")
                  .mapInArrow(_open(edits), "k long, lid long, label long, tokens int, size byte, odd0 long, odd1 long"), "line-open")
    # Each line that is left with the keys of its open groups; in each it meets the others with its text.
    again = left.groupBy(*[c for c in _OPEN if c != "k"]).agg(F.collect_list("k").alias("keys"))
    links = (with_texts(again).join(text, "lid").select("*", F.explode("keys").alias("k"))
             .repartition(parts, "k").sortWithinPartitions("k").mapInArrow(_compared(edits), "a long, b long"))

    # Of large groups a label of many lines has blocks of its own, which need not meet each other; others share some.
    large = labelled(large)
    of = (large.groupBy("k", "label").agg(F.count("*").alias("n"))
          .groupBy("k", F.when(F.col("n") > block, F.col("label")).otherwise(F.lit(-1)).alias("own")).agg(F.sum("n").alias("n"))
          .groupBy("k").agg(F.collect_list(F.struct("own", F.ceil(F.col("n") / block).alias("blocks"))).alias("of")))
    alone = (F.size("of") == 1) & (F.col("of")[0]["own"] >= 0)  # one label: done
    large = stored(large.join(of.where(~alone), "k"), "line-large")
    if not large.isEmpty():
        own = F.when(F.exists("of", lambda x: x["own"] == F.col("label")), F.col("label")).otherwise(F.lit(-1))
        one = (large.withColumn("own", own)
               .withColumn("mine", F.struct("own", F.pmod(F.xxhash64("lid"), F.filter("of", lambda x: x["own"] == F.col("own"))[0]["blocks"]).alias("block")))
               .withColumn("of", F.explode(F.filter("of", lambda x: (x["own"] != F.col("own")) | (x["own"] < 0))))
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of.blocks") - 1)))
               .withColumn("other", F.struct(F.col("of.own"), F.col("other").alias("block")))
               .select("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                       (F.col("mine") > F.col("other")).cast("int").alias("side"), "lid", "label", "tokens", "size", "odd0", "odd1"))
        keys = large.groupBy("lid").agg(F.collect_list("k").alias("keys"))
        links = links.unionByName(one.join(text.join(keys, "lid"), "lid").groupBy("k", "i", "j").applyInPandas(_blocks(edits), "a long, b long"))
    return components(links, known).withColumnRenamed("v", "lid")


def line_classes(rows: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(places, repeated) of rows (_key, text).

    places: (_key, pos, h1, h2, place) of each line that counts; repeated:
    (h1, h2, first) of lines whose class has further places than ``first``.
    A place is one number: a long, if all keys are of 31 bits.
    """
    ends = rows.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).first()
    wide = ends["lo"] is not None and not -(1 << 31) < ends["lo"] <= ends["hi"] < 1 << 31
    line = (rows.select("_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .where(F.length("line") >= min_chars))
    place = F.col("_key") * F.lit(1 << 31) + F.col("pos") if not wide else (F.col("_key").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    h1, h2 = F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")
    distinct = stored(line.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first"))
                      .select("line", "n", "first", h1, h2, F.monotonically_increasing_id().alias("lid")), "lines")
    of = line_links(distinct, edits)
    named = distinct.select("lid", "n", "first", "h1", "h2")
    alone = named.where("n > 1")
    linked = stored(named.join(of, "lid"), "line-linked")
    firsts = linked.groupBy("label").agg(F.min("first").alias("first"))
    repeated = (alone.join(of, "lid", "left_anti").select("h1", "h2", "first")
                .unionByName(linked.drop("first").join(firsts, "label").select("h1", "h2", "first")))
    return line.select("_key", "pos", h1, h2, place.alias("place")), stored(repeated, "line-repeated")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
               min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the later lines of each class deleted from the text, and ``lines_dropped``."""
    rows, _ = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "id")
    places, repeated = line_classes(rows.select("_key", text_or_empty().alias("text")), edits, min_chars)
    drops = stored(places.join(repeated, ["h1", "h2"]).where("place <> first")
                   .groupBy("_key").agg(F.collect_list("pos").alias("drops")), "line-drops")

    # A text that keeps all its lines is passed on as it is. The split lines are named once, so each is looked up in them.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    without = F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept[0])
    return (with_texts(rows).join(drops, "_key", "left").withColumn("text", without)
            .select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns],
                    F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("lines_dropped")))
