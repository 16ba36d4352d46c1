"""Approximate nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors get one more component that makes all norms equal, which turns the
largest inner product into the smallest distance, and a random rotation.
k-means on a bounded sample (``SAMPLE``) gives the list centres; every vector
is put in a list.  A query scans the lists of its nearest centres.  Within a
list, distances grow by column blocks of ``COLUMNS`` dimensions; after each, a
candidate is given up when its partial distance, scaled to all dimensions,
exceeds the k-th distance of the query's nearest list, which is scanned first,
by more than the hypothesis test's margin (1 + ``EPSILON`` / sqrt(t))^2, or
exceeds the query's current k-th distance as it is.  Those that are left are
scored exactly, in double precision, on the original vectors.

Queries and vectors meet as matrices: ``ASKED`` queries and ``BLOCK`` vectors,
sorted by list, are a row of a stored table each, and the rows are paired by a
product of partitions, which reads the tables and shuffles neither.  Only a
query's best leave a task; no copy of a vector is written for a query or a
list.  A tile of queries and vectors is scanned whole while many of its pairs
are left, and pair by pair afterwards, in single precision (double where one
vector is much longer than most) with a margin above its rounding.

Equal vectors are indexed once, with the k + 1 smallest ids that carry them:
more can't be among k neighbours, as ties go to the smaller id.  A list that
holds a third of all vectors lies in many blocks, its queries in many rows.

Defined cases: vectors that are null, zero, of another length than most or
with a null or non-finite component take no part, nor do null ids; a row
repeated whole counts once; of one id with several vectors each is a
candidate, never for its own id; fewer candidates than k give them all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom.llm.common import settings, stored

K = 20
EVERY = 20
SAMPLE = 20_000
COLUMNS = 16
EPSILON = 2.1
PROBED = 0.85 # share of the lists that a query scans
MAX_LISTS = 256
BLOCK = 4096  # vectors of a row
SORTED = 65_536  # vectors that a task sorts by list at a time
ASKED, FEWEST = 4096, 256  # queries of a row
_EXTRA = 4  # candidates kept beyond k, against rounding
_TILE = 1024, 512  # queries and vectors that are scanned as matrices
_HEAD = 64  # vectors that a query without a k-th distance sees at first
_PAIRWISE = 64  # a tile goes on pair by pair if one pair of so many is left for each column block to come, or fewer
_SLACK = 100  # roundings that the scan's sums are allowed
_SCORED = 16_384  # pairs scored at a time

#: Rows are blocks of about 1 MB: few are read or sent to Python at a time, and each file is a partition.
_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.parquet.columnarReaderBatchSize": "16",
         "spark.sql.files.openCostInBytes": "1g"}


def _finite(vec: str):
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, h1, h2): valid vectors of the commonest length; single floats stay such, all else is doubles."""
    kind = "array<float>" if dict(table.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = (table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
         .where(F.col("id").isNotNull() & _finite("v")))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    dims, same = sizes["n"] if sizes else 0, F.col("v").cast("array<double>")
    return v.where(F.size("v") == dims).select("id", "v", F.xxhash64(same).alias("h1"), F.xxhash64(same, F.lit(1)).alias("h2"))


class Index:
    """Rotation, centres and scale; a few hundred vectors, whatever the table."""

    def __init__(self, sample: np.ndarray, top: float, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.top2 = top * top or 1.0
        # Where one long vector leaves the others next to each other, single precision would sift nothing.
        self.real = np.float32 if np.median((sample * sample).sum(1)) > self.top2 / 1000 else np.float64
        self.dims = sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0]
        x = self.rotate(sample)
        n = max(1, min(MAX_LISTS, len(x), int(math.sqrt(rows) / 2)))
        centres = x[rng.choice(len(x), n, replace=False)]
        for _ in range(12):
            near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
            for c in range(n):
                own = x[near == c]
                centres[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
        self.centres = centres
        self.probes = max(1, math.ceil(PROBED * n))

    def rotate(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.top2 - (v * v).sum(1)))
        return np.hstack([v, more[:, None]]) @ self.turn

    def distances(self, q: np.ndarray) -> np.ndarray:
        return (q * q).sum(1)[:, None] + (self.centres ** 2).sum(1) - 2 * q @ self.centres.T

    def list_of(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        few = range(0, len(v), 1024)  # of which all distances stay in the processor's cache
        return np.concatenate([np.argmin(self.distances(self.rotate(v[at:at + 1024].astype(float), query)), axis=1) for at in few]).astype("i4")


def _rows(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), float)


def _cut(x: np.ndarray, columns: int, real: type, query: bool = False) -> list[np.ndarray]:
    """Column blocks of which a query's row times a vector's is their squared distance there, less the query's own square."""
    out = []
    for at in range(0, x.shape[1], columns):
        b = x[:, at:at + columns]
        out.append(np.hstack([b, np.ones((len(b), 1))] if query else [-2 * b, (b * b).sum(1)[:, None]]).astype(real))
    return out


class Bounds:
    """By column block and query: the test's bounds on partial distances, and the query's own squares."""

    def __init__(self, q: np.ndarray, bound: np.ndarray, columns: int, epsilon: float, real: type):
        dims, self.real = q.shape[1], real
        ends = [min(dims, at + columns) for at in range(0, dims, columns)]
        self.own = np.cumsum(q * q, axis=1)[:, [t - 1 for t in ends]].T
        self.test = np.array([bound if t == dims else bound * t / dims * (1 + epsilon / math.sqrt(t)) ** 2 for t in ends])

    def of(self, who, limit: np.ndarray) -> np.ndarray:
        return (np.minimum(self.test[:, who], limit) - self.own[:, who] + _SLACK * np.finfo(self.real).eps).astype(self.real)


def adaptive_tile(x: list[np.ndarray], q: list[np.ndarray], bounds: np.ndarray, room: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs q[i], x[j] that no column block gives up; x and q are cut, room is overwritten."""
    shape = len(q[0]), len(x[0])
    part, step, keep, below = (r[:shape[0] * shape[1]].reshape(shape) for r in room)
    i = None
    for b, (xb, qb, bound) in enumerate(zip(x, q, bounds, strict=True), 1):
        if i is None:
            np.matmul(qb, xb.T, out=part if b == 1 else step)
            if b > 1:
                np.add(part, step, out=part)
            np.less_equal(part, bound[:, None], out=keep if b == 1 else below)
            if b > 1:
                np.logical_and(keep, below, out=keep)
            if np.count_nonzero(keep) * _PAIRWISE <= keep.size * (len(x) - b):
                at = np.flatnonzero(keep)
                (i, j), rest = np.divmod(at, shape[1]), part.ravel()[at]
        elif len(i):
            rest = rest + np.einsum("ij,ij->i", qb[i], xb[j])
            at = np.flatnonzero(rest <= bound[i])
            i, j, rest = i[at], j[at], rest[at]
    return (i, j) if i is not None else np.divmod(np.flatnonzero(keep), shape[1])


def _room(pairs: int, real: type) -> list[np.ndarray]:
    return [np.empty(pairs, real), np.empty(pairs, real), np.empty(pairs, bool), np.empty(pairs, bool)]


def adaptive_scan(x: np.ndarray, q: np.ndarray, k: int, limit: float, columns: int = COLUMNS, epsilon: float = EPSILON):
    """(rows, squared distances) of the up to k nearest of x to q, abandoning the hopeless."""
    head = min(len(x), 2 * k)
    first = ((x[:head] - q) ** 2).sum(1)
    if head >= k:
        limit = min(limit, float(np.partition(first, k - 1)[k - 1]))
    scale = math.sqrt(max((x * x).sum(1).max(), q @ q)) or 1.0
    bounds = Bounds(q[None] / scale, np.array([limit / scale ** 2]), columns, epsilon, float)
    _, left = adaptive_tile(_cut(x[head:] / scale, columns, float), _cut(q[None] / scale, columns, float, True),
                            bounds.of([0], limit / scale ** 2), _room(len(x) - head, float))
    rows = np.concatenate([np.arange(head), head + left])
    dist = ((x[rows] - q) ** 2).sum(1)
    if len(rows) > k:
        nearest = np.argpartition(dist, k - 1)[:k]
        rows, dist = rows[nearest], dist[nearest]
    return rows, dist


class Asked:
    """Queries of a row, and the best that a task has found for each."""

    def __init__(self, index: Index, ids: np.ndarray, v: np.ndarray, floor: np.ndarray, home: bool, keep: int):
        x = index.rotate(v, query=True)
        order = np.argsort(index.distances(x), axis=1, kind="stable")[:, :index.probes]
        self.lists = np.zeros((len(index.centres), len(v)), bool)  # by list: who scans it
        order = order[:, :1] if home else order[:, 1:]
        self.lists[order.ravel(), np.repeat(np.arange(len(v)), order.shape[1])] = True
        self.ids, self.v, self.keep, self.top2 = ids, v, keep, index.top2
        self.square = (v * v).sum(1)
        self.floor, self.least = floor, floor.copy()
        self.scores = np.full((len(v), keep), -np.inf)
        self.found = np.zeros((len(v), keep), np.int64)
        x /= math.sqrt(self.top2)
        self.cut, self.bounds = _cut(x, COLUMNS, index.real, True), Bounds(x, self.limit(slice(None)), COLUMNS, EPSILON, index.real)
        self.pending, self.waiting, self.room = [], 0, _room(_TILE[0] * _TILE[1], index.real)

    def limit(self, who) -> np.ndarray:
        """Largest squared distance, in parts of the largest norm's square, that can still be among the best."""
        return np.where(np.isfinite(self.least[who]), 1 + (self.square[who] - 2 * self.least[who]) / self.top2, np.inf)

    def meet(self, block: Block) -> None:
        for name, start, end in block.lists:
            of_list = np.flatnonzero(self.lists[name])
            for at in range(0, len(of_list), _TILE[0]):
                who = of_list[at:at + _TILE[0]]
                q, s = [b[who] for b in self.cut], start
                while s < end:
                    limit = self.limit(who)
                    new = not np.isfinite(limit).all()
                    e = min(end, s + min(_TILE[1], _HEAD if new else end))
                    i, j = adaptive_tile([b[s:e] for b in block.cut], q, self.bounds.of(who, limit), self.room)
                    self.score(who[i], s + j, block)
                    if new or self.waiting > self.scores.size:
                        self.merge()
                    s = e

    def score(self, i: np.ndarray, j: np.ndarray, block: Block) -> None:
        for at in range(0, len(i), _SCORED):
            qi, xj = i[at:at + _SCORED], j[at:at + _SCORED]
            s = np.cumsum(self.v[qi] * block.v[xj], axis=1)[:, -1]  # added up in the order of the components
            ok = s >= self.least[qi]
            if ok.any():
                self.pending.append((qi[ok], s[ok], block.ids[xj[ok]]))
                self.waiting += len(self.pending[-1][0])

    def merge(self) -> None:
        if not self.pending:
            return
        q, s, r = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.waiting = [], 0
        who = np.unique(q)
        q = np.concatenate([np.repeat(who, self.keep), q])
        s, r = np.concatenate([self.scores[who].ravel(), s]), np.concatenate([self.found[who].ravel(), r])
        order = np.lexsort((r, -s, q))
        q, s, r = q[order], s[order], r[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.keep
        self.scores[q[best], rank[best]], self.found[q[best], rank[best]] = s[best], r[best]
        self.least[who] = np.maximum(self.floor[who], self.scores[who, -1])

    def rows(self) -> pa.RecordBatch:
        self.merge()
        q, rank = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([self.ids[q], self.found[q, rank], self.scores[q, rank]], ["q", "rid", "score"])


class Block:
    """Vectors of a row, sorted by list."""

    def __init__(self, index: Index, ids: np.ndarray, lists: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        starts = np.flatnonzero(np.diff(lists, prepend=-1))
        self.lists = list(zip(lists[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(lists)], strict=True))
        self.cut = _cut(index.rotate(v) / math.sqrt(index.top2), COLUMNS, index.real)


_FOUND = "q long, rid long, score double"


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _search(index: Index, dtype: str, home: bool, keep: int):
    dims = index.dims - 1

    def run(batches):
        asked: dict[int, Asked] = {}
        block, last = None, None
        for b in batches:
            of = lambda c, i, kind, b=b: np.frombuffer(b.column(c)[i].as_buffer(), kind)
            vectors = lambda c, i: of(c, i, dtype).reshape(-1, dims).astype(float)  # noqa: E731, B023
            for i in range(b.num_rows):
                ids, q = of("ids", i, "i8"), of("q", i, "i8")
                if last != ids[0]:
                    block, last = Block(index, ids.copy(), of("lists", i, "i4"), vectors("x", i)), int(ids[0])
                if (first := int(q[0])) not in asked:
                    asked[first] = Asked(index, q.copy(), vectors("v", i), of("floor", i, "f8").copy(), home, keep)
                asked[first].meet(block)
        for a in asked.values():
            yield a.rows()
    return run


def _blocks(reps: DataFrame, index: Index, dtype: str) -> DataFrame:
    """(lo, hi, ids, lists, x): vectors sorted by list, BLOCK to a row, of lists lo to hi."""
    def sort(held):
        ids, lists, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(lists, kind="stable")
        for at in range(0, len(order), BLOCK):
            o = order[at:at + BLOCK]
            yield pa.RecordBatch.from_pylist([{"lo": int(lists[o[0]]), "hi": int(lists[o[-1]]), "ids": ids[o].tobytes(),
                                               "lists": lists[o].tobytes(), "x": v[o].tobytes()}], schema)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                held.append((b.column("rid").to_numpy(), index.list_of(v), v.astype(dtype)))
                n += len(v)
            if n >= SORTED:
                yield from sort(held)
                held, n = [], 0
        if held:
            yield from sort(held)

    schema = pa.schema([("lo", pa.int32()), ("hi", pa.int32()), *((c, pa.binary()) for c in ("ids", "lists", "x"))])
    return stored(reps.select("rid", "v").mapInArrow(run, "lo int, hi int, ids binary, lists binary, x binary"), "vector-blocks")


def _homes(reps: DataFrame, index: Index, kind: str) -> DataFrame:
    """(q, list, v): what is asked for, and the list of the nearest centre."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                near = index.list_of(_matrix(b.column("v")), query=True)
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(near), b.column("v")], ["q", "list", "v"])

    return stored(reps.where("asked").select("rid", "v").mapInArrow(run, f"q long, list int, v {kind}"), "queries")


def _asked(queries: DataFrame, parts: int, dtype: str) -> DataFrame:
    """(first, last, q, v, floor): queries sorted by list, at most ASKED to a row, of lists first to last."""
    def run(batches):
        held = [(b.column("q").to_numpy(), b.column("list").to_numpy(), _matrix(b.column("v")).astype(dtype), b.column("floor").to_numpy())
                for b in batches if b.num_rows]
        if held:
            q, lists, v, floor = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((q, lists))
            for at in range(0, len(order), ASKED):
                o = order[at:at + ASKED]
                yield pa.RecordBatch.from_pylist([{"first": int(lists[o[0]]), "last": int(lists[o[-1]]), "q": q[o].tobytes(),
                                                   "v": v[o].tobytes(), "floor": floor[o].tobytes()}], schema)

    schema = pa.schema([("first", pa.int32()), ("last", pa.int32()), *((c, pa.binary()) for c in ("q", "v", "floor"))])
    return stored(queries.repartitionByRange(parts, "list", "q").mapInArrow(run, "first int, last int, q binary, v binary, floor binary"), "asked-rows")


def _scan(blocks: DataFrame, queries: DataFrame, rows: int, index: Index, dtype: str, home: bool, keep: int) -> DataFrame:
    """The best of each query in its nearest list, or in the others that it scans; queries has (q, list, v, floor)."""
    spark = queries.sparkSession
    asked, tasks = queries.count(), 2 * spark.sparkContext.defaultParallelism
    parts = max(1, math.ceil(asked / min(ASKED, max(FEWEST, asked // tasks))))
    # Few queries leave cores idle unless the vectors are dealt out as well.
    cuts = min(math.ceil(rows / BLOCK), math.ceil(tasks / parts))
    packed = _asked(queries, parts, dtype)
    meets = F.col("lo").between(F.col("first"), F.col("last")) | F.col("first").between(F.col("lo"), F.col("hi")) if home else F.lit(True)
    with settings(spark, _ROWS):
        pairs = blocks.coalesce(cuts).join(packed.coalesce(parts).hint("shuffle_replicate_nl"), meets)
        return stored(pairs.select("ids", "lists", "x", "q", "v", "floor").mapInArrow(_search(index, dtype, home, keep), _FOUND), "scanned")


def _best(found: DataFrame, k: int) -> DataFrame:
    return (found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "rid")))
            .where(F.col("r") <= k).select("q", "rid", "score"))


def nearest(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, id, score: for each id divisible by ``every``, its k nearest other rows."""
    spark, all_rows = table.sparkSession, usable(table, id_col, vec_col)
    vectors = stored(all_rows.select("id", "h1", "h2").distinct(), "vector-ids")
    # One id may carry several vectors: the key of a vector is its hash pair.
    reps = stored(all_rows.groupBy("h1", "h2").agg(F.min("id").alias("rid0"), F.first("v").alias("v"), F.max(F.col("id") % every == 0).alias("asked"))
                  .select(F.xxhash64("h1", "h2", "rid0").alias("rid"), "v", "h1", "h2", "asked"), "vector-reps")
    kind, double = dict(reps.dtypes)["v"], F.col("v").cast("array<double>")
    dtype = "f4" if kind == "array<float>" else "f8"
    facts = reps.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    # The sample has the smallest hashes: of large tables most rows can't be among them.
    small = reps.where(F.col("h1") < int((1.2 * SAMPLE / facts["n"] - 0.5) * 2 ** 64)) if facts["n"] > 2 * SAMPLE else reps
    sample = small.orderBy("h1", "h2").limit(SAMPLE).select("v").toPandas()  # at most SAMPLE vectors
    index = Index(_rows(sample["v"]), facts["top"], facts["n"])

    workers = max(spark.sparkContext.defaultParallelism, math.ceil(facts["n"] / SORTED))
    blocks = _blocks(reps.coalesce(workers), index, dtype)
    queries = _homes(reps, index, kind)
    keep = k + 1 + _EXTRA  # the query's own vector may be among them
    lowest = F.lit(float("-inf"))
    home = stored(_best(_scan(blocks, queries.withColumn("floor", lowest), facts["n"], index, dtype, True, keep), keep), "home")
    limits = home.groupBy("q").agg(F.when(F.count("*") >= keep, F.min("score")).otherwise(lowest).alias("floor"))
    rest = _scan(blocks, queries.join(limits, "q", "left").withColumn("floor", F.coalesce("floor", lowest)), facts["n"], index, dtype, False, keep)
    found = stored(_best(home.unionByName(rest), keep), "found")

    # The ids behind equal vectors.
    first = Window.partitionBy("h1", "h2").orderBy("id")
    members = (vectors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
               .join(reps.select("h1", "h2", "rid"), ["h1", "h2"]).select("rid", "id"))
    # Per distinct query vector at most k + 1 ids can matter: one may be the query itself.
    ids = stored(found.join(members, "rid").withColumn("r", F.row_number().over(
        Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= k + 1).select("q", "id", "score"), "ids")
    asked = stored(vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h1", "h2")
                   .join(reps.select("h1", "h2", F.col("rid").alias("q")), ["h1", "h2"]).select("query_id", "q"), "asked")
    return (asked.join(ids, "q").where("query_id <> id")
            .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")).cast("int"))
            .where(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
