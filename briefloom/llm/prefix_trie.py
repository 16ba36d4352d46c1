"""The prefix trie of conversations, by double arrays.

1. *Turns.*  A turn is named by 128 bits of a digest of role and text; texts
   go no further.  Rows are range-sorted and numbered across partitions, so a
   conversation of any length is no single group.  A conversation is cut into
   pieces of ``LAYER`` turns; a piece's prefix names all turns before it.
2. *Prefix shards.*  Pieces of one layer are range-sorted by prefix and turns,
   and every ``SHARD`` turns of a partition become a trie: turns get dense ids,
   BASE and CHECK arrays are packed by first fit, and all pieces walk them at
   once, which gives every node its members.  One first turn may begin any
   share of the conversations; its shard is cut behind later turns.
3. *Merge.*  In sorted order a node that two shards share lies on the last path
   of one and on the first of the other.  All other nodes are done in their
   shard.  Sums of the two paths are merged shard by shard in a task, then over
   ``FAN`` tasks at a time until one group is left; in each round what lies on
   neither outer path is done.
4. Layers are done from the deepest on; what is below a layer is handed to the
   node of the layer above that ends in it.

Members that end at a node are hashed in its shard; those of shared nodes
come as runs of sorted ids and go through the hash run by run.

Defined cases: null roles and texts are empty; rows without a conversation id
belong to no conversation and are left out; turns of equal number stand in
the order of their names, repeated rows beside each other; a conversation of
which no turn is left is a member of the root alone; an empty table has no
node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import stored
from briefloom.llm.jaccard_join import _scramble

LAYER = 256
SHARD = 65_536
FAN = 256
_RUN = 4096  # ids in a run
_FREE = -1
_WINDOW = 2048  # free slots tried for a node with several children
_NONE = hashlib.sha256(b"").hexdigest()

NODE = {"k1": pa.int64(), "k2": pa.int64(), "q1": pa.int64(), "q2": pa.int64(), "conv_id": pa.int64(), "depth": pa.int64(),
        "parent_conv_id": pa.int64(), "n": pa.int64(), "kids": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(),
        "asked": pa.bool_(), "root": pa.bool_(), "sha": pa.string()}
PART = {"size": pa.int64(), "first": pa.bool_(), "last": pa.bool_(), "place": pa.int64()}
RUNS = {"run": pa.binary(), "start": pa.int64()}
_ROW = {"kind": pa.int32(), **NODE, **PART, **RUNS}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields: dict) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in fields.items())


def _batch(rows: dict[str, list | np.ndarray], fields: dict = _ROW) -> pa.RecordBatch:
    n = len(next(iter(rows.values())))
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) if k in rows else pa.nulls(n, t) for k, t in fields.items()], list(fields))


class DoubleArray:
    """Tries in one pair of BASE and CHECK arrays; a root for each of ``roots`` in the first slots.

    A child of state s by label x is in slot BASE[s] + x, if CHECK there is s.
    """

    def __init__(self, roots: int):
        self.base = np.zeros(max(16, 2 * roots), np.int64)
        self.check = np.full(max(16, 2 * roots), _FREE, np.int64)
        self.check[:roots] = -2
        self.top = roots

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.check = np.concatenate([self.check, np.full(more, _FREE, np.int64)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])

    def insert(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Slots of new children: distinct (state, label), sorted; the states have no children yet."""
        new = np.ones(len(states), bool)
        new[1:] = states[1:] != states[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(states)))
        slots = np.empty(len(states), np.int64)
        free = np.flatnonzero(self.check[:self.top] == _FREE)
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] == 1:
                break
            at, n = starts[g], sizes[g]
            away = labels[at:at + n] - labels[at]
            free = free[self.check[free] == _FREE] if len(free) > _WINDOW else free
            tried = np.append(free[:_WINDOW], self.top)
            self._room(int(self.top + away[-1] + 1))
            fits = (self.check[tried[:, None] + away[None, :]] == _FREE).all(axis=1) if n * len(tried) < 1 << 22 else (tried == self.top)
            slot = int(tried[np.argmax(fits)])
            slots[at:at + n] = slot + away
            self.base[states[at]] = slot - labels[at]
            self.check[slot + away] = states[at]
            if slot + away[-1] >= self.top:
                fresh = np.arange(self.top, slot + away[-1] + 1)
                free = np.append(free, fresh)
                self.top = int(slot + away[-1] + 1)
        single = starts[sizes == 1]
        free = free[self.check[free] == _FREE][:len(single)]
        own = np.append(free, np.arange(self.top, self.top + len(single) - len(free)))
        self.top += len(single) - len(free)
        self._room(self.top)
        slots[single] = own
        self.base[states[single]] = own - labels[single]
        self.check[own] = states[single]
        return slots

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children's slots, -1 where there is none."""
        at = self.base[states] + labels
        inside = (at >= 0) & (at < self.top)
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == states), at, -1)


def _named(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of children by turns ``ids`` (two numbers each) of nodes named k1, k2."""
    return (_scramble(k1 + _scramble(ids[:, 0] ^ np.uint64(0x5851F42D4C957F2D))),
            _scramble(k2 * np.uint64(0x9E3779B97F4A7C15) + _scramble(ids[:, 1] + np.uint64(0x14057B7EF767814F))))


def shard_trie(p: dict, layer: int, depth_cut: int = LAYER):
    """(node rows, rows of the two outer paths, runs of ended members) of a shard's sorted pieces.

    ``p``: p1, p2, n1, n2 (prefix before and behind), ids (turns, 2 numbers),
    size, starts, conv, ended, add_kids, add_leaves, add_saved, deeper.
    """
    starts, lengths, conv = p["starts"], np.diff(p["starts"]), p["conv"]
    new = np.ones(len(conv), bool)
    new[1:] = (p["p1"][1:] != p["p1"][:-1]) | (p["p2"][1:] != p["p2"][:-1])
    root_of = np.cumsum(new) - 1
    roots = int(root_of[-1]) + 1
    flat = p["ids"].copy().view([("a", np.uint64), ("b", np.uint64)]).reshape(-1)
    names, dense = np.unique(flat, return_inverse=True)
    names, dense = names.view(np.uint64).reshape(-1, 2), dense + 1

    trie = DoubleArray(roots)
    levels, state, live = [np.arange(roots)], root_of.copy(), np.arange(len(conv))
    while True:
        d = len(levels) - 1
        live = live[lengths[live] > d]
        if len(live) == 0:
            break
        label = dense[starts[live] + d]
        order = np.lexsort((label, state[live]))
        s, x = state[live][order], label[order]
        one = np.ones(len(s), bool)
        one[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
        levels.append(trie.insert(s[one], x[one]))
        state[live] = trie.step(state[live], label)

    size = trie.top
    n, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    parent, width, depth = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    k1, k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    k1[:roots], k2[:roots] = p["p1"][new].view(np.uint64), p["p2"][new].view(np.uint64)
    # The walk: all pieces at once, a turn at a time.
    state, live = root_of.copy(), np.arange(len(conv))
    first, last = np.zeros(size, bool), np.zeros(size, bool)
    for d in range(len(levels)):
        if d:
            live = live[lengths[live] >= d]
            turn = starts[live] + d - 1
            before = state[live]
            now = trie.step(before, dense[turn])
            state[live] = now
            parent[now], width[now], depth[now] = before, p["size"][turn], d
            k1[now], k2[now] = _named(k1[before], k2[before], names[dense[turn] - 1])
            if d == depth_cut:
                k1[now], k2[now] = p["n1"][live].view(np.uint64), p["n2"][live].view(np.uint64)
        np.add.at(n, state[live], 1)
        np.minimum.at(low, state[live], conv[live])
        first[state[0]] = True
        last[state[-1]] = True

    # ``state`` is now the node where each piece ends.
    kids, leaves, saved, asked = (np.zeros(size, np.int64) for _ in range(4))
    for add, into in (("add_kids", kids), ("add_leaves", leaves), ("add_saved", saved), ("deeper", asked)):
        np.add.at(into, state, p[add])
    outer = first | last
    for slots in reversed(levels):
        done = slots[~outer[slots]]
        leaves[done[kids[done] == 0]] = 1
        saved[done] += (n[done] - 1) * width[done] * (depth[done] > 0)
        up = done[parent[done] >= 0]
        np.add.at(kids, parent[up], 1)
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])

    every = np.concatenate(levels)
    inner, edge = every[~outer[every]], every[outer[every]]
    ends = np.flatnonzero(p["ended"])
    at = state[ends]
    cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[:len(at)]
    shas, runs = {}, []
    for lo, hi in zip(cut, np.append(cut[1:], len(at))[:len(at)], strict=True):
        slot, members = int(at[lo]), conv[ends[lo:hi]].tolist()
        if not outer[slot]:
            shas[slot] = hashlib.sha256(",".join(map(str, members)).encode()).hexdigest()
        else:
            runs += [(slot, members[i], ",".join(map(str, members[i:i + _RUN])).encode()) for i in range(0, len(members), _RUN)]

    s1, s2 = k1.view(np.int64), k2.view(np.int64)
    up = np.maximum(parent, 0)
    # A node whose members other shards may share, or that ends the layer above, is named later.
    known = ~outer[up[inner]] & (depth[inner] > 0) & ((layer == 0) | (depth[inner] > 1))
    whole = layer * depth_cut + depth
    nodes = {"kind": np.zeros(len(inner), np.int32), "k1": s1[inner], "k2": s2[inner], "q1": s1[up[inner]], "q2": s2[up[inner]],
             "conv_id": low[inner], "depth": whole[inner], "parent_conv_id": pa.array(low[up[inner]], mask=~known), "n": n[inner],
             "kids": kids[inner], "leaves": leaves[inner], "saved": saved[inner], "asked": asked[inner] > 0, "root": depth[inner] == 0,
             "sha": [shas.get(s, _NONE) for s in inner.tolist()]}
    edges = [{"k1": int(s1[s]), "k2": int(s2[s]), "q1": int(s1[up[s]]), "q2": int(s2[up[s]]), "conv_id": int(low[s]), "depth": int(whole[s]),
              "n": int(n[s]), "kids": int(kids[s]), "leaves": int(leaves[s]), "saved": int(saved[s]), "size": int(width[s]),
              "root": bool(depth[s] == 0), "first": bool(first[s]), "last": bool(last[s])} for s in edge.tolist()]
    return nodes, edges, [(int(s1[s]), int(s2[s]), start, run) for s, start, run in runs]


def merged(paths: list[list[dict]], layer: int, top: bool) -> tuple[list[dict], list[dict]]:
    """(nodes that are done, rows of the two outer paths) of neighbouring shards' outer paths, in order."""
    nodes: dict[tuple, dict] = {}
    for i, rows in enumerate(paths):
        for r in rows:
            key = (r["k1"], r["k2"])
            first, last = r["first"] and i == 0, r["last"] and i == len(paths) - 1
            if (have := nodes.get(key)) is None:
                nodes[key] = {**r, "first": first, "last": last}
            else:
                have["conv_id"] = min(have["conv_id"], r["conv_id"])
                for c in ("n", "kids", "leaves", "saved"):
                    have[c] += r[c]
                have["first"] |= first
                have["last"] |= last
    done, kept = [], []
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        if not top and (r["first"] or r["last"]):
            kept.append(r)
            continue
        r["leaves"] = r["leaves"] if r["kids"] else 1
        r["saved"] += (r["n"] - 1) * r["size"] * (not r["root"])
        above = None if r["root"] else nodes.get((r["q1"], r["q2"]))
        if above is not None:
            above["kids"] += 1
            above["leaves"] += r["leaves"]
            above["saved"] += r["saved"]
        open_ = above is None or (not top and (above["first"] or above["last"])) or (above["root"] and layer > 0)
        done.append({**r, "parent_conv_id": None if open_ else above["conv_id"], "asked": True, "sha": None})
    return done, kept


def _rows(done: list[dict], kept: list[dict], place: int) -> Iterator[pa.RecordBatch]:
    if done:
        yield _batch({"kind": [0] * len(done), **{c: [r[c] for r in done] for c in NODE}})
    if kept:
        yield _batch({"kind": [1] * len(kept), "place": [place] * len(kept),
                      **{c: [r[c] for r in kept] for c in (*NODE, *PART) if c in kept[0] and c != "place"}})


def _turn_numbers(lists: pa.Array) -> np.ndarray:
    data = lists.flatten()
    at = data.offset * 16 if pa.types.is_fixed_size_binary(data.type) else int(np.frombuffer(data.buffers()[1], np.int32)[data.offset]) if len(data) else 0
    buffer = data.buffers()[-1]
    return np.frombuffer(buffer, ">u8", 2 * len(data), at).astype(np.uint64).reshape(-1, 2) if len(data) else np.empty((0, 2), np.uint64)


def _shards(layer: int, shard: int, depth_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, paths = TaskContext.get().partitionId(), []
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            lists = t.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            p = {c: t.column(c).to_numpy(zero_copy_only=False) for c in
                 ("p1", "p2", "n1", "n2", "conv", "ended", "add_kids", "add_leaves", "add_saved", "deeper")}
            p |= {"ids": _turn_numbers(lists), "size": t.column("sizes").flatten().to_numpy(zero_copy_only=False), "starts": offsets - offsets[0]}
            nodes, edges, runs = shard_trie(p, layer, depth_cut)
            if len(nodes["k1"]):
                yield _batch(nodes)
            if runs:
                yield _batch({"kind": [2] * len(runs), **{c: [r[i] for r in runs] for i, c in enumerate(("k1", "k2", "start", "run"))}})
            # Of a task's shards only the outer paths stay.
            if paths:
                done, kept = merged([paths.pop(), edges], layer, False)
                paths.append(kept)
                yield from _rows(done, [], place)
            else:
                paths.append(edges)

        turns = 0
        for b in batches:
            lengths = np.diff(b.column("ids").offsets.to_numpy()) + 1
            at = 0
            while at < b.num_rows:
                fits = int(np.searchsorted(np.cumsum(lengths[at:]), shard - turns, "right"))
                take = min(b.num_rows - at, max(fits, 0 if turns else 1))
                if take:
                    held.append(b.slice(at, take))
                    turns += int(lengths[at:at + take].sum())
                    at += take
                if at < b.num_rows:
                    yield from packed()
                    turns = 0
        if held:
            yield from packed()
        if paths:
            yield from _rows([], paths[0], place)
    return run


def _merge_group(layer: int, width: int, top: bool):
    fields = {"kind": pa.int32(), **NODE, **PART}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        paths: dict[int, list] = {}
        for r in table.to_pylist():
            paths.setdefault(r["place"], []).append(r)
        done, kept = merged([paths[k] for k in sorted(paths)], layer, top)
        place = key[0].as_py() * width
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(c) for c in fields], list(fields)) for b in _rows(done, kept, place)],
                                     pa.schema(fields.items()))
    return run, _ddl(fields)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node over its runs, which come in order."""
    now, h = None, None
    for b in batches:
        out = []
        for k1, k2, run in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("run"), strict=True):
            if (k1, k2) != now:
                if now is not None:
                    out.append((*now, h.hexdigest()))
                now, h = (k1, k2), hashlib.sha256()
            else:
                h.update(b",")
            h.update(run.as_py())
        if out:
            yield _batch({c: [r[i] for r in out] for i, c in enumerate(("k1", "k2", "ended"))}, {"k1": pa.int64(), "k2": pa.int64(), "ended": pa.string()})
    if now is not None:
        yield _batch({"k1": [now[0]], "k2": [now[1]], "ended": [h.hexdigest()]}, {"k1": pa.int64(), "k2": pa.int64(), "ended": pa.string()})


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, each row's place (from 0) in its group; a group of any size may lie across partitions."""
    ordered = stored(rows.orderBy(group, *order).withColumn("_row", F.monotonically_increasing_id())
                     .withColumn("_part", F.shiftright("_row", 33)), "numbered")
    parts = ordered.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_lo"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select(group, "_part", "_lo", F.coalesce(before, F.lit(0)).alias("_before")), "numbered-parts")
    return (ordered.join(parts, [group, "_part"]).withColumn("pos", F.col("_row") - F.col("_lo") + F.col("_before"))
            .drop("_row", "_part", "_lo", "_before"))


def named_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, id, size): each conversation's turns in order, by name and size of text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", name.alias("id"), F.octet_length(text).cast("long").alias("size"))
    return numbered(rows, "conv", F.col("turn").asc_nulls_first(), F.col("id")).drop("turn")


def rebuilt(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where each takes the first ``head`` turns of conversation ``base`` in place of its own."""
    turns = stored(turns, "turns")
    sizes = stored(turns.groupBy("conv").agg((F.max("pos") + 1).alias("n")), "turn-counts")
    convs = sizes.select("conv", base.alias("base"), head.cast("long").alias("head"))
    of = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(of, "base", "left").select("conv", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken")), "rebuilt")
    begin = (convs.select("conv", "base", "head")
             .join(turns.select(F.col("conv").alias("base"), "pos", "id", "size"), "base").where("pos < head").select("conv", "pos", "id", "size"))
    rest = (turns.join(convs.select("conv", "head", "taken"), "conv").where("pos >= head")
            .select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("pos"), "id", "size"))
    return convs.select("conv"), begin.unionByName(rest)


def _pieces(convs: DataFrame, turns: DataFrame, cut: int) -> DataFrame:
    """(conv, layer, ids, sizes, p1, p2, n1, n2, ended): pieces of at most ``cut`` turns."""
    groups = (turns.withColumn("layer", F.floor(F.col("pos") / cut)).groupBy("conv", "layer")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size"))).alias("rows"))
              .select("conv", "layer", F.col("rows.id").alias("ids"), F.col("rows.size").alias("sizes")))
    groups = stored(groups, "pieces")
    # Names of prefixes: of each piece a hash of its place and turns, and the exclusive or over the pieces before.
    by = Window.partitionBy("conv").orderBy("layer")
    named = groups.select("conv", "layer", *[F.xxhash64("layer", "ids", F.lit(i)).alias(f"d{i}") for i in (1, 2)])
    for i in (1, 2):
        before = F.bit_xor(f"d{i}").over(by.rowsBetween(Window.unboundedPreceding, -1))
        named = named.withColumn(f"p{i}", F.coalesce(before, F.lit(0).cast("long")))
    named = (named.withColumn("n1", F.col("p1").bitwiseXOR(F.col("d1"))).withColumn("n2", F.col("p2").bitwiseXOR(F.col("d2")))
             .withColumn("ended", F.col("layer") == F.max("layer").over(Window.partitionBy("conv"))).drop("d1", "d2"))
    bare = convs.join(groups.select("conv").distinct(), "conv", "left_anti")
    zero = F.lit(0).cast("long")
    return groups.join(named, ["conv", "layer"]).unionByName(
        bare.select("conv", zero.alias("layer"), F.array().cast("array<binary>").alias("ids"), F.array().cast("array<long>").alias("sizes"),
                    *[zero.alias(c) for c in ("p1", "p2", "n1", "n2")], F.lit(True).alias("ended")))


def prefix_trie(convs: DataFrame, turns: DataFrame, layer: int = LAYER, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos, id, size) of all ``convs`` (conv).

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    pieces = stored(_pieces(convs, turns, layer), "trie-pieces")
    deepest = pieces.agg(F.max("layer")).first()[0]
    nodes, runs, below = [], [], None
    for k in range(-1 if deepest is None else deepest, -1, -1):
        own = pieces.where(F.col("layer") == k)
        zero = F.lit(0).cast("long")
        if below is None:
            own = own.select("*", *[zero.alias(c) for c in ("add_kids", "add_leaves", "add_saved", "deeper")])
        else:
            # What lies below a piece's end goes to one piece that ends there.
            of = below.select(F.col("conv_id").alias("conv"), F.col("k1").alias("n1"), F.col("k2").alias("n2"),
                              F.col("kids").alias("add_kids"), F.col("leaves").alias("add_leaves"), F.col("saved").alias("add_saved"), F.lit(1).cast("long").alias("deeper"))
            own = (own.join(of, ["conv", "n1", "n2"], "left")
                   .withColumns({c: F.coalesce(F.col(c), zero) for c in ("add_kids", "add_leaves", "add_saved", "deeper")}))
        by = ["p1", "p2", "ids", "conv"]
        rows = own.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_shards(k, shard, layer), _ddl(_ROW))
        rows = stored(rows, "trie-rows")
        found = [rows.where("kind = 0").select(*NODE)]
        runs.append(rows.where("kind = 2").select("k1", "k2", "start", "run"))
        paths, width = rows.where("kind = 1").select("kind", *NODE, *PART), 1
        tasks = (paths.agg(F.max("place")).first()[0] or 0) + 1
        while True:
            width *= fan
            merge, ddl = _merge_group(k, width, width >= tasks)
            after = stored(paths.groupBy(F.floor(F.col("place") / width).alias("g")).applyInArrow(merge, ddl), "trie-merged")
            found.append(after.where("kind = 0").select(*NODE))
            if width >= tasks:
                break
            paths = after.where("kind = 1")
        every = reduce(DataFrame.unionByName, found)
        nodes.append(every if k == 0 else every.where("not root"))
        below = every.where("root") if k else None
    if not nodes:
        return convs.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    every = reduce(DataFrame.unionByName, nodes)
    ends = (reduce(DataFrame.unionByName, runs).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start")
            .mapInArrow(_hashed, "k1 long, k2 long, ended string"))
    every = (every.where("sha is not null").unionByName(
        every.where("sha is null").join(stored(ends, "trie-ends"), ["k1", "k2"], "left")
        .withColumn("sha", F.coalesce("ended", F.lit(_NONE))).drop("ended")))
    every = stored(every, "trie-nodes")
    above = every.where("asked").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("above"))
    open_ = F.col("parent_conv_id").isNull() & (F.col("depth") > 0)
    out = every.where(~open_).unionByName(
        every.where(open_).join(above, ["q1", "q2"]).withColumn("parent_conv_id", F.col("above")).drop("above"))
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, layer: int = LAYER,
                      shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text).

    With ``base`` and ``head``, expressions of ``conv``, each conversation
    begins with the first ``head`` turns of conversation ``base`` instead of
    its own.
    """
    turns = named_turns(conversations)
    if base is None:
        turns = stored(turns, "turns")
        return prefix_trie(turns.select("conv").distinct(), turns, layer, shard, fan)
    return prefix_trie(*rebuilt(turns, base, head), layer, shard, fan)
