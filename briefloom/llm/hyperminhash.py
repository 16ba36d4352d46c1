"""Near-copy detection by HyperMinHash registers.

1. *Registers.*  A document is the set of 64-bit hashes of its word shingles.
   The top bits of a hash pick one of ``BUCKETS`` buckets; the smallest rest in
   a bucket is kept as its leading-zero count (4 bits) and the ``MANTISSA``
   bits behind the first one: 14 bits a bucket, 0 for a bucket without hashes.
2. *Banding.*  ``ROWS`` registers in a row are one band; documents with an
   equal band meet.  At a similarity of 0.8 a pair misses all 32 bands of four
   registers with odds of 5e-8; bands without a hash are no band.
3. *Estimate.*  Pairs that meet pass only if their registers' Jaccard estimate,
   less the collisions expected of two sets of such sizes, comes within
   ``SIGMAS`` standard errors of the threshold, and if their sizes allow it and
   their parities: each shingle flips one of ``PARITY`` bits, so two sets differ
   by at least as many shingles as bits.  All of it runs on packed longs in the
   JVM, as the condition of the joins and in the first band that a pair shares,
   so no other pair ever becomes a row.
4. *Verification* on whole sets.  What is linked is decided here alone.

Equal sets are one class from the start.  Classes link up in rounds: each
band has one hub, a class is tried against the ``HUBS`` hubs that it shares
most bands with and verified against the ``TRIED`` best estimates, and joins
their components, so groups of near copies of any size collapse in linear
work; then all remaining pairs that meet across components are tried.  Of a
band's component with the most classes no two are paired again.

Defined cases: null, empty or blank texts have an empty set and link with
nothing; fewer words than a shingle make one shingle; null and repeated ids
are rows of their own (``common.keyed``), a null id is behind all others;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import components, keyed, stored, text_or_empty, with_texts
from briefloom.llm.jaccard_join import _scramble, _WordHashes, shingle_set

SHINGLE = 4
SIMILARITY = 80  # per cent
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
ROWS = 4
MANTISSA = 10
ZEROS = 14  # larger counts are kept as this one: they begin with sets of some million shingles
LANE = MANTISSA + 4
SIGMAS = 6.0
HUB_ROUNDS = 3
HUBS = 8
TRIED = 2
PARITY = 1024
_REST = 64 - BUCKET_BITS
_LANES = [f"r{i}" for i in range(BUCKETS // 4)]  # four registers in a long
_PARITIES = [f"x{i}" for i in range(PARITY // 64)]
_PACKED = [*_LANES, "o0", "o1", *_PARITIES]  # o: a bit for each bucket that has a hash
_FLUSH, _SETS = 500_000, 2048  # shingles and sets compressed at a time

# The constant of the published estimate of expected collisions.
_COLLISION = 0.169919487159739093975315012348


def registers(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) registers of ascending hashes (uint64) with their ascending owners."""
    out = np.zeros((n, BUCKETS), np.uint16)
    if len(hashes) == 0:
        return out
    bucket = (hashes >> np.uint64(_REST)).astype(np.int64)
    new = np.ones(len(hashes), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    # 53 bits of the rest go through a float exactly; frexp then gives the length.
    least = (hashes[new] & np.uint64((1 << _REST) - 1)) >> np.uint64(_REST - 53)
    length = np.maximum(np.frexp(least.astype(np.float64))[1], 53 - ZEROS)
    mantissa = (least >> (length - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    zeros = (53 - length).astype(np.uint64)
    out[owner[new], bucket[new]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, used) of each row's bands: four registers and the band's number in one long."""
    lanes = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    joined = np.zeros(lanes.shape[:2], np.uint64)
    for i in range(ROWS):
        joined |= lanes[:, :, i] << np.uint64(16 * i)
    keys = _scramble(joined + _scramble(np.arange(1, joined.shape[1] + 1, dtype=np.uint64))[None, :])
    return keys.view(np.int64), joined != 0


def packed(regs: np.ndarray) -> np.ndarray:
    """Four registers in a long, each with a free bit above it."""
    lanes = regs.reshape(len(regs), -1, 4).astype(np.int64)
    return sum(lanes[:, :, i] << (LANE + 1) * i for i in range(4))


def bits(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as longs."""
    return np.packbits(rows, axis=1, bitorder="little").view(np.int64)


def parities(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each set, the bits that an odd number of its hashes fall on."""
    place = np.repeat(np.arange(len(lengths)) * PARITY, lengths) + (hashes & np.uint64(PARITY - 1)).astype(np.int64)
    return (np.bincount(place, minlength=len(lengths) * PARITY).reshape(-1, PARITY) & 1).astype(bool)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()

        def flushed(keys: list, sets: list) -> pa.RecordBatch:
            lengths = np.array([len(s) for s in sets], np.int64)
            both = np.concatenate([s.view(np.uint64) ^ np.uint64(1 << 63) for s in sets]) if sets else np.empty(0, np.uint64)
            regs = registers(both, np.repeat(np.arange(len(sets)), lengths), len(sets))
            key, used = bands(regs)
            columns = np.concatenate([packed(regs), bits(regs != 0), bits(parities(both, lengths))], axis=1)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(lengths),
                 *[pa.array([int.from_bytes(p[i:i + 8], "little", signed=True) for p in prints], pa.int64()) for i in (0, 8)],
                 *[pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in
                   ((key[used], pa.int64()), (np.nonzero(used)[1].astype(np.int32), pa.int32()))],
                 *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(_PACKED))]],
                ["_key", "n", "fa", "fb", "bands", "numbers", *_PACKED])

        for b in batches:
            keys, sets, held = [], [], 0
            texts = b.column("text").cast(pa.binary())
            for key, text in zip(b.column("_key").to_pylist(), (x.as_py() for x in texts), strict=True):
                s = shingle_set(text, words, size)
                keys.append(key)
                sets.append(s)
                held += len(s)
                if held >= _FLUSH or len(sets) >= _SETS:
                    yield flushed(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield flushed(keys, sets)
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for b in batches:
            keys, sets, held = [], [], 0
            texts = b.column("text").cast(pa.binary())
            for key, text in zip(b.column("_key").to_pylist(), (x.as_py() for x in texts), strict=True):
                keys.append(key)
                sets.append(shingle_set(text, words, size))
                held += len(sets[-1])
                if held >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["_key", "tokens"])
                    keys, sets, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["_key", "tokens"])
    return run


def _differing(x: Column) -> Column:
    """How many lanes of the exclusive or of two packed longs are not 0: adding all ones carries into a lane's free bit."""
    ones = sum(((1 << LANE) - 1) << (LANE + 1) * i for i in range(4))
    free = sum(1 << LANE << (LANE + 1) * i for i in range(4))
    return F.bit_count((x + F.lit(ones)).bitwiseAND(F.lit(free)))


def estimate(a: str, b: str) -> tuple[Column, Column]:
    """(Jaccard estimate corrected for collisions, buckets that either side has) of columns with suffixes a and b."""
    def sides(c):
        return F.col(f"{c}_{a}"), F.col(f"{c}_{b}")

    apart = None
    for c in _LANES:
        x, y = sides(c)
        lanes = _differing(x.bitwiseXOR(y))
        apart = lanes if apart is None else apart + lanes
    either = None
    for c in ("o0", "o1"):
        x, y = sides(c)
        either = F.bit_count(x.bitwiseOR(y)) if either is None else either + F.bit_count(x.bitwiseOR(y))
    small, large = (f(*sides("n")).cast("double") for f in (F.least, F.greatest))
    ratio = large / small
    collisions = F.lit(_COLLISION * 2.0 ** (BUCKET_BITS - MANTISSA) * 4) * ratio / ((F.lit(1.0) + ratio) * (F.lit(1.0) + ratio))
    return ((either - apart).cast("double") - collisions) / F.greatest(either, F.lit(1)), either


def _may_link(a: str, b: str, similarity: int, sigmas: float = SIGMAS) -> Column:
    """Sizes and estimate allow the similarity."""
    t = similarity / 100
    jaccard, buckets = estimate(a, b)
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = None
    for c in _PARITIES:
        odd = F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}")))
        apart = odd if apart is None else apart + odd
    return ((F.lit(100 + similarity) * apart <= F.lit(100 - similarity) * (n_a + n_b)) & (F.lit(100) * F.least(n_a, n_b) >= F.lit(similarity) * F.greatest(n_a, n_b))
            & (jaccard >= F.lit(t) - F.lit(sigmas * (t * (1 - t)) ** 0.5) / F.sqrt(buckets.cast("double"))))


def _first_band(a: str, b: str) -> Column:
    """The number of the first band that two classes share; a long holds a band."""
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(_LANES))):
        x, y = F.col(f"{c}_{a}"), F.col(f"{c}_{b}")
        out = F.when((x == y) & (x != 0), F.lit(i)).otherwise(out)
    return out


def signatures(rows: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, met) of rows (_key, text).

    members: _key, n, rep (the smallest key with an equal set).  classes: the
    reps that share a band with another, with n and packed registers.  met:
    (band, number, _key) of the bands that several classes have.
    """
    kept = "_key long, n long, fa long, fb long, bands array<long>, numbers array<int>, " + ", ".join(f"{c} long" for c in _PACKED)
    signed = stored(rows.mapInArrow(_signatures(size), kept), "hmh-signatures")
    named = signed.select("_key", "n", "fa", "fb")
    equal = stored(named.where("n > 0").groupBy("fa", "fb").agg(F.min("_key").alias("rep")), "hmh-equal")
    members = (named.where("n > 0").join(equal, ["fa", "fb"]).select("_key", "n", "rep")
               .unionByName(named.where("n = 0").select("_key", "n", F.col("_key").alias("rep"))))
    reps = equal.select(F.col("rep").alias("_key"))
    spread = (signed.select("_key", "bands", "numbers").join(reps, "_key", "left_semi")
              .select("_key", F.explode(F.arrays_zip("bands", "numbers")).alias("x"))
              .select(F.col("x.bands").alias("band"), F.col("x.numbers").alias("number"), "_key"))
    spread = stored(spread, "hmh-bands")
    often = spread.groupBy("band").count().where("count > 1").select("band")
    met = stored(spread.join(often, "band"), "hmh-met")
    classes = stored(signed.drop("bands", "numbers", "fa", "fb").join(met.select("_key").distinct(), "_key", "left_semi"), "hmh-classes")
    return stored(members, "hmh-members"), classes, met


def link(rows: DataFrame, classes: DataFrame, met: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY,
         hub_rounds: int = HUB_ROUNDS) -> DataFrame | None:
    """(v, label): component of each class that has a link; None if there is none."""
    sets = stored(with_texts(rows).join(classes.select("_key"), "_key", "left_semi")
                  .mapInArrow(_sets(size), "_key long, tokens array<long>"), "hmh-sets")
    edges, comp = None, None

    def side(x: str) -> DataFrame:
        return classes.select(F.col("_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *_PACKED)])

    def whole(x: str) -> DataFrame:
        return sets.select(F.col("_key").alias(x), F.col("tokens").alias(f"t_{x}"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("t_a", "t_b"))
        either = F.size("t_a") + F.size("t_b") - both
        return pairs.join(whole("a"), "a").join(whole("b"), "b").where(100 * both >= similarity * either).select("a", "b")

    def labelled() -> DataFrame:
        if comp is None:
            return met.withColumn("comp", F.col("_key"))
        return (met.join(comp, met["_key"] == comp["v"], "left")
                .select("band", "number", "_key", F.coalesce("label", "_key").alias("comp")))

    def join_up(found: DataFrame) -> bool:
        nonlocal edges, comp
        found = stored(found, "hmh-links")
        if found.isEmpty():
            return False
        edges = found if edges is None else edges.unionByName(found)
        comp = components(edges)
        return True

    for seed in range(hub_rounds):
        now = stored(labelled(), "hmh-rows")
        # The hub of a band: the class with the smallest seeded hash; first the same one in many bands, then any.
        order = F.xxhash64("_key", "band", F.lit(seed)) if seed else F.xxhash64("_key")
        hubs = stored(now.groupBy("band").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(F.struct(order.alias("h"), F.col("_key").alias("b"), F.col("comp").alias("comp_b"))).alias("hub"))
            .where("lo < hi").select("band", "hub.b", "hub.comp_b"), "hmh-hubs")
        most = Window.partitionBy("a").orderBy(F.col("common").desc(), "b")
        tried = (now.join(hubs, "band").where("comp <> comp_b").groupBy(F.col("_key").alias("a"), "b").agg(F.count("*").alias("common"))
                 .withColumn("r", F.row_number().over(most)).where(F.col("r") <= HUBS).select("a", "b"))
        best = Window.partitionBy("a").orderBy(F.col("like").desc(), "b")
        near = stored(stored(tried, "hmh-tried").join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b", similarity))
                      .select("a", "b", estimate("a", "b")[0].alias("like")).withColumn("r", F.row_number().over(best))
                      .where(F.col("r") <= TRIED).select("a", "b"), "hmh-near")
        if not join_up(verified(near)):
            break

    now = stored(labelled(), "hmh-rows")
    sized = now.groupBy("band", "comp").count()
    major = stored(sized.groupBy("band").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("major"))
                   .where("comps > 1").select("band", "major"), "hmh-major")
    mixed = stored(now.join(major, "band").join(classes, "_key"), "hmh-mixed")

    def named(x: str) -> list[Column]:
        return [F.col("_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", *_PACKED)]]

    few = mixed.where("comp <> major").select("band", "number", *named("a"))
    every = mixed.select("band", *named("b"), (F.col("comp") == F.col("major")).alias("big"))
    pairs = (few.join(every, "band").where("comp_a <> comp_b and (big or a < b)")
             .where(_may_link("a", "b", similarity) & (_first_band("a", "b") == F.col("number"))).select("a", "b"))
    join_up(verified(stored(pairs, "hmh-pairs")))
    return comp


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                similarity: int = SIMILARITY, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept."""
    keyed_docs, is_id = keyed(docs, id_col)
    rows = keyed_docs.select("_key", text_or_empty(text_col).alias("text"))
    members, classes, met = signatures(rows, size)
    comp = link(rows, classes, met, size, similarity, hub_rounds)
    if comp is None:
        out = members.select("_key", F.col("n").alias("n_shingles"), F.col("rep").alias("comp"))
    else:
        out = (members.join(comp, members["rep"] == comp["v"], "left")
               .select("_key", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("comp")))
    kept = (F.col("_key") == F.col("comp")).alias("kept")
    if is_id:
        return out.select(F.col("_key").alias(id_col), "n_shingles", F.col("comp").alias("component_id"), kept)
    ids = keyed_docs.select("_key", id_col)
    return (out.join(ids, "_key").join(ids.select(F.col("_key").alias("comp"), F.col(id_col).alias("component_id")), "comp")
            .select(id_col, "n_shingles", "component_id", kept))
