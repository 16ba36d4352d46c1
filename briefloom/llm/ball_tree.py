"""Ranked lexical search: exact inner products by sparse ball trees.

A document's vector has, for each term of the items searched for, the term's
weight times its damped count in the document, both whole numbers.  An item is
a vector of ones on its terms, so its score of a document is the inner
product, a sum of whole numbers.

1. *Vectors.*  One pass over the texts counts every document's terms and keeps
   the counts of terms that items have; document frequencies follow from them.
2. *Trees.*  Vectors are range-sorted by their heaviest terms, so that like
   documents come together, and every ``CHUNK`` of them in a partition becomes
   a tree: a node is halved along the line between two far documents until
   ``LEAF`` are left.  A node keeps its centroid and, for each of ``BLOCKS``
   blocks of terms, the radius around it in that block.
3. *Search.*  No document of a node scores more than the centroid's inner
   product plus, over the blocks, radius times the norm of the item's part
   there.  Bounds are rounded up beyond any error of floats.  For each item the
   node with the highest bound is opened first; a subtree that can't reach the
   tenth best score so far is never opened.  At leaves the sums are exact.
   A first search over a bounded number of documents gives every partition a
   score to beat.

Items are searched for in blocks of about ``BLOCK_BYTES`` of their text; a
block's terms and weights are what tasks are given and what the driver sees
(single items with more text stand alone).  Documents never meet the driver.

Defined cases: null and empty texts have no terms, of documents as of items;
an item without terms or without a document that scores above 0 has no rows;
repeated items are searched for each by themselves; repeated and null
document ids are rows of their own (``common.keyed``), null behind all others
among equal scores; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import keyed, stored, text_or_empty

TOP = 10
CHUNK = 2048
LEAF = 16
BLOCKS = 256
BLOCK_BYTES = 1 << 20
SEED_ROWS = 16_384
_SLACK = 1e-9

# A term is a run of ASCII letters and digits and of all characters beyond ASCII.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_VECTOR = "_key long, n long, ids array<int>, counts array<int>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damped(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The count's part of a score, in 64-bit integers."""
    m = 10 + 90 * n * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, counts, sizes = [], [], [], []
            for text in b.column("text").cast(pa.binary()):
                found = terms(text.as_py())
                n.append(len(found))
                i, c = np.unique(np.array([vocabulary[t] for t in found if t in vocabulary], np.int32), return_counts=True)
                ids.append(i)
                counts.append(c)
                sizes.append(len(i))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, flat(ids)),
                 pa.ListArray.from_arrays(offsets, flat(counts))], ["_key", "n", "ids", "counts"])
    return run


def _weighted(weights: np.ndarray, n_docs: int, n_terms: int):
    """Vectors, and their three heaviest terms to sort by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ids, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            counts = b.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.repeat(b.column("n").to_numpy(), sizes)
            y = weights[ids] * damped(counts, n, n_docs, n_terms)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((ids, -y, owner))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            heavy = []
            for k in range(3):
                top = np.full(len(sizes), -1, np.int32)
                long = sizes > k
                top[long] = ids[order[starts[:-1][long] + k]]
                heavy.append(pa.array(top))
            offsets = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), *heavy, pa.ListArray.from_arrays(offsets, pa.array(ids)),
                 pa.ListArray.from_arrays(offsets, pa.array(y))], ["_key", "h1", "h2", "h3", "ids", "y"])
    return run


class BallTree:
    """A tree over rows of (ids, values) with one radius for each block of dimensions."""

    def __init__(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray, leaf: int = LEAF, blocks: int = BLOCKS):
        self.dims, self.local = np.unique(ids, return_inverse=True)
        self.starts, self.values, self.y = starts, values, values.astype(np.float64)
        self.block = np.arange(len(self.dims)) % blocks
        self.blocks = blocks
        self.sizes = np.diff(starts)
        self.centers: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self._grow(np.arange(len(self.sizes)), leaf)
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of each entry of the rows, number of its row among them)."""
        sizes = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        shift = self.starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.arange(len(owner)) + shift[owner], owner

    def _grow(self, all_rows: np.ndarray, leaf: int) -> None:
        todo = [(all_rows, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.children)
            if parent >= 0:
                self.children[parent][side] = node
            at, owner = self._entries(rows)
            d, y = self.local[at], self.y[at]
            center = np.bincount(d, y, len(self.dims)) / len(rows)
            # Squared distances by row and block: what is not an entry is as far as the centroid itself.
            base = np.bincount(self.block, center * center, self.blocks)
            part = np.bincount(owner * self.blocks + self.block[d], (y - center[d]) ** 2 - center[d] ** 2, len(rows) * self.blocks)
            part = part.reshape(len(rows), self.blocks) + base
            largest = np.bincount(owner * self.blocks + self.block[d], y * y, len(rows) * self.blocks).reshape(len(rows), self.blocks).max(axis=0)
            self.centers.append(center)
            self.radii.append(np.sqrt(np.maximum(part.max(axis=0), 0) * (1 + _SLACK) + _SLACK * (base + largest)))
            if len(rows) <= leaf:
                self.children.append(None)
                self.rows.append(rows)
                continue
            self.children.append([-1, -1])
            self.rows.append(None)
            one = self._dense(rows[np.argmax(part.sum(axis=1))])
            other = self._dense(rows[np.argmax(self._apart(d, y, owner, len(rows), one))])
            along = np.bincount(owner, y * (one - other)[d], len(rows))
            order = np.argsort(along, kind="stable")
            todo += [(rows[order[:len(rows) // 2]], node, 0), (rows[order[len(rows) // 2:]], node, 1)]

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.dims))
        out[self.local[self.starts[row]:self.starts[row + 1]]] = self.y[self.starts[row]:self.starts[row + 1]]
        return out

    @staticmethod
    def _apart(d: np.ndarray, y: np.ndarray, owner: np.ndarray, n: int, point: np.ndarray) -> np.ndarray:
        return np.bincount(owner, (y - point[d]) ** 2 - point[d] ** 2, n)

    def bounds(self, items: list[np.ndarray]) -> np.ndarray:
        """(node, item): what no row below the node exceeds."""
        ones = np.zeros((len(self.dims), len(items)))
        for i, t in enumerate(items):
            ones[np.searchsorted(self.dims, t[np.isin(t, self.dims)]), i] = 1
        norms = np.zeros((self.blocks, len(items)))
        np.add.at(norms, self.block, ones)
        return (self.centers @ ones + self.radii @ np.sqrt(norms)) * (1 + _SLACK) + 1

    def scores(self, rows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact scores; item: whether each dimension of the tree is one of its terms."""
        at, owner = self._entries(rows)
        mine = item[self.local[at]]
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, owner[mine], self.values[at[mine]])
        return out


def search(tree: BallTree, keys: np.ndarray, items: list[np.ndarray], best: list[list], least: list[int], top: int = TOP) -> int:
    """Best-first over the tree for every item; ``best`` has heaps of (score, -key).  Returns the leaves opened."""
    opened = 0
    bounds = tree.bounds(items)
    for i, t in enumerate(items):
        heap = best[i]
        floor = max(least[i], heap[0][0] if len(heap) == top else 1)
        if bounds[0, i] < floor:
            continue
        mine = np.isin(tree.dims, t)
        if not mine.any():
            continue
        todo = [(-bounds[0, i], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < floor:
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if bounds[child, i] >= floor:
                        heapq.heappush(todo, (-bounds[child, i], child))
                continue
            opened += 1
            rows = tree.rows[node]
            scores = tree.scores(rows, mine)
            for r in np.flatnonzero(scores >= floor).tolist():
                one = (int(scores[r]), -int(keys[rows[r]]))
                if len(heap) < top:
                    heapq.heappush(heap, one)
                elif one > heap[0]:
                    heapq.heapreplace(heap, one)
            floor = max(floor, heap[0][0] if len(heap) == top else 1)
    return opened


def _searched(items: list[np.ndarray], least: list[int], top: int, chunk: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                lists = part.column("ids")
                starts = lists.offsets.to_numpy().astype(np.int64)
                ids, y = lists.flatten().to_numpy(zero_copy_only=False), part.column("y").flatten().to_numpy(zero_copy_only=False)
                tree = BallTree(starts - starts[0], ids, y, leaf)
                search(tree, part.column("_key").to_numpy(), items, best, least, top)
        rows = [(i, -key, score) for i, heap in enumerate(best) for score, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "_key", "score"])
    return run


def _best(vectors: DataFrame, items: list[np.ndarray], least: list[int], top: int, chunk: int, leaf: int) -> DataFrame:
    """(item, _key, score, rank) of the best rows, from trees over range-sorted vectors."""
    near = vectors.repartitionByRange("h1", "h2", "h3", "_key").sortWithinPartitions("h1", "h2", "h3", "_key")
    found = near.select("_key", "ids", "y").mapInArrow(_searched(items, least, top, chunk, leaf), "item long, _key long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("_key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", top: int = TOP, chunk: int = CHUNK, leaf: int = LEAF,
                  block_bytes: int = BLOCK_BYTES, seed_rows: int = SEED_ROWS) -> DataFrame:
    """The ``top`` best documents of each item: item id, rank, document id, score."""
    spark = docs.sparkSession
    keyed_docs, is_id = keyed(docs, id_col)
    rows = keyed_docs.select("_key", text_or_empty(text_col).alias("text"))
    asked = stored(items.select(F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text"))
                   .withColumn("_item", F.monotonically_increasing_id()), "search-items")
    held = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-held // block_bytes))
    results = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).select("_item", "text").collect()
        wanted = [(r["_item"], set(terms(r["text"].encode()))) for r in own]
        wanted = [(k, t) for k, t in wanted if t]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, x in wanted for t in x}))}
        if not vocabulary:
            continue
        counted = stored(rows.mapInArrow(_counted(vocabulary), _VECTOR), "search-counts")
        n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for t, n in counted.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # at most the block's terms
            df[t] = n
        held_rows = int((df > 0).any()) and counted.where(F.size("ids") > 0).count()
        if not held_rows:
            continue
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        vectors = counted.where(F.size("ids") > 0).mapInArrow(
            _weighted(weights, n_docs, n_terms), "_key long, h1 int, h2 int, h3 int, ids array<int>, y array<long>")
        ids = [np.array(sorted(vocabulary[t] for t in x), np.int32) for _, x in wanted]
        # Real scores of some documents: what the tenth best of all must at least reach.
        least = [1] * len(ids)
        part = -(-held_rows // seed_rows)
        first = _best(vectors.where(F.pmod(F.xxhash64("_key"), F.lit(part)) == 0), ids, least, top, chunk, leaf)
        for i, score in first.where(F.col("rank") == top).select("item", "score").collect():
            least[i] = score
        found = stored(_best(vectors, ids, least, top, chunk, leaf), "search-best")
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(wanted)], "item long, _item long")
        results.append(found.join(names, "item").select("_item", "rank", "_key", "score"))
    if not results:
        results.append(spark.createDataFrame([], "_item long, rank int, _key long, score long"))
    out = reduce(DataFrame.unionByName, results).join(asked.select("_item", "item_id"), "_item")
    if is_id:
        found_id = F.col("_key").alias("found_id")
    else:
        out, found_id = out.join(keyed_docs.select("_key", F.col(id_col).alias("found_id")), "_key"), F.col("found_id")
    return out.select(F.col("item_id").alias(item_col), "rank", found_id, "score").withColumnRenamed("found_id", id_col)
