"""N-gram Jaccard join by filters under several global token orders.

A document is the set of hashes of its word shingles.  Two sets with Jaccard
similarity at least t share a token among the first n - ceil(t n) + 1 of each
under *any* order of all tokens; so a pair must pass that test under each of
several orders before it is verified.

1. *Random order.*  Each set gives the longer prefix of its tokens in hash
   order in which l = 1 + n // 8 of them must be shared.  Sets with too few
   tokens that any other set has there are done; usually most are.
2. *Rare first orders.*  For the rest every token is counted.  A token that
   one set alone has comes first and matches nothing, so a set with enough of
   those is done as well.  Orders 2 to 4 sort the shared tokens by frequency
   and hash, by the power of two of the frequency and another hash, and again
   by another hash.
3. Pairs come from order 2 with length, positional and bitmap filters, are
   intersected with orders 3 and 4, and verified on whole sets.

Equal sets are one class from the start.  Classes link up in rounds: first
each is verified against the hub of the prefix tokens it has most in common
with, and joined to its component; large groups of near copies collapse so,
in linear work.  Then all candidate pairs across components are verified, so
that no link that would join two components is missed.

Tokens are 64-bit hashes of five words; the odds that any two shingles of a
pair collide are below 1e-9 for texts of 100,000 words.

Defined cases: null, empty or blank texts have an empty set and link with
nothing; fewer words than a shingle make one token; null and repeated ids
count as rows of their own (see ``common.keyed``); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import components, keyed, stored, text_or_empty, with_texts

SHINGLE = 5
SIMILARITY = 75  # per cent
STAR_ROUNDS = 3
_WORDS_KEPT = 500_000  # word hashes kept by a task before it starts anew


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and .split do exactly A-Z and ASCII space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - size + 1 + j]
    return np.unique(_scramble(acc).view(np.int64))


def _ceil(n: int, similarity: int) -> int:
    return -(-n * similarity // 100)


def _signatures(size: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            keys, n, fa, fb, prefix = b.column("_key").to_pylist(), [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, hashes, size)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                fa.append(int.from_bytes(d[:8], "little", signed=True))
                fb.append(int.from_bytes(d[8:], "little", signed=True))
                prefix.append(s[:len(s) - _ceil(len(s), similarity) + 1 + len(s) // 8])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(fa, pa.int64()),
                 pa.array(fb, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["_key", "n", "fa", "fb", "prefix"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes, size) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(sets, pa.list_(pa.int64()))], ["_key", "tokens"])
    return run


def _ceil_col(n: Column, similarity: int) -> Column:
    return F.ceil(n * similarity / F.lit(100)).cast("long")


def _bitmap() -> list[Column]:
    """256 bits in four longs, one of them set by each shared token."""
    def word(i: int) -> Column:
        mine = F.filter("shared", lambda x: F.pmod(x["tok"], F.lit(4)) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x["tok"], 2), F.lit(64)).cast("int"))))
    return [word(i).alias(f"bits{i}") for i in range(4)]


BITS = [f"bits{i}" for i in range(4)]


def prefixes(rows: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of rows (_key, text).

    members: _key, n, rep (the smallest key with an equal set).  classes: the
    reps that may have links, with n, their shared tokens and p1 to p3, the
    prefixes under the three rare first orders.
    """
    signed = stored(rows.mapInArrow(_signatures(size, similarity),
                                    "_key long, n long, fa long, fb long, prefix array<long>"), "signatures")
    equal = stored(signed.where("n > 0").groupBy("fa", "fb").agg(F.min("_key").alias("rep")), "equal")
    members = stored(signed.where("n > 0").select("_key", "n", "fa", "fb").join(equal, ["fa", "fb"])
                     .select("_key", "n", "rep")
                     .unionByName(signed.where("n = 0").select("_key", "n", F.col("_key").alias("rep"))), "members")

    reps = equal.select(F.col("rep").alias("_key"))
    tokens = stored(signed.select("_key", "prefix").join(reps, "_key", "left_semi"), "prefixes").select(
        "_key", F.explode("prefix").alias("tok"))
    shared = stored(tokens.groupBy("tok").count().where("count > 1").select("tok"), "shared")
    found = tokens.join(shared, "tok").groupBy("_key").count()
    need = 1 + F.floor(_ceil_col(F.col("n"), similarity) / 8)
    left = stored(found.join(members.select("_key", "n"), "_key").where(F.col("count") >= need).select("_key", "n"), "left")

    sets = stored(with_texts(rows).join(left.select("_key"), "_key", "left_semi").mapInArrow(_sets(size), "_key long, tokens array<long>"),
                  "sets")
    tokens = sets.select("_key", F.explode("tokens").alias("tok"))
    counts = stored(tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    kept = (tokens.join(counts, "tok").groupBy("_key").agg(F.collect_list(F.struct("df", "tok")).alias("shared"))
            .join(left, "_key"))
    room = F.col("n") - _ceil_col(F.col("n"), similarity) + 1 - (F.col("n") - F.size("shared"))

    def prefix(*by) -> Column:
        order = F.array_sort(F.transform("shared", lambda x: F.struct(*[f(x).alias(f"c{i}") for i, f in enumerate(by)], x["tok"].alias("tok"))))
        return F.transform(F.slice(order, 1, F.col("room").cast("int")), lambda x: x["tok"])

    power = lambda x: F.floor(F.log2(x["df"].cast("double")))
    classes = kept.withColumn("room", room).where("room > 0").select(
        "_key", "n", F.transform("shared", lambda x: x["tok"]).alias("tokens"),
        prefix(lambda x: x["df"]).alias("p1"),
        prefix(power, lambda x: F.xxhash64(x["tok"], F.lit(2))).alias("p2"),
        prefix(power, lambda x: F.xxhash64(x["tok"], F.lit(3))).alias("p3"),
        (F.col("n") - F.size("shared")).alias("alone"), *_bitmap())
    return members, stored(classes, "classes")


def _verified(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that pass the other orders and are similar enough."""
    side = lambda x: classes.select(F.col("_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "p2", "p3")])
    near = stored(
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
        .where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
        .select("a", "b", "n_a", "n_b"), "near")
    whole = lambda x: classes.select(F.col("_key").alias(x), F.col("tokens").alias(f"t_{x}"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (near.join(whole("a"), "a").join(whole("b"), "b").withColumn("both", both)
            .where(100 * F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))


def link(classes: DataFrame, similarity: int = SIMILARITY, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(v, label): component of each class that has a link."""
    # at: the token's place in the whole set, unshared tokens included.
    rows = stored(classes.select("_key", "n", "alone", *BITS, F.posexplode("p1").alias("i", "tok"))
                  .select("_key", "n", "alone", *BITS, "tok", (F.col("alone") + F.col("i") + 1).alias("at")), "p1")
    comp = None

    def labelled() -> DataFrame:
        if comp is None:
            return rows.withColumn("comp", F.col("_key"))
        return (rows.join(comp, rows["_key"] == comp["v"], "left")
                .select(*rows.columns, F.coalesce("label", "_key").alias("comp")))

    def live() -> DataFrame:
        return stored(labelled(), "rows")

    def join_up(found: DataFrame):
        nonlocal comp
        found = stored(found, "links")
        if found.isEmpty():
            return False
        comp = components(found, comp)
        return True

    for seed in range(star_rounds):
        now = live()
        # The hub of a token: the class with the smallest seeded hash, so that rounds try different ones.
        hubs = stored(now.groupBy("tok").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(F.xxhash64("_key", F.lit(seed)) if seed else F.col("_key")).alias("hub")).where("lo < hi"), "hubs")
        of = classes.select("_key", (F.xxhash64("_key", F.lit(seed)) if seed else F.col("_key")).alias("hub")).join(
            comp.withColumnRenamed("v", "_key"), "_key", "left") if comp is not None else classes.select(
            "_key", (F.xxhash64("_key", F.lit(seed)) if seed else F.col("_key")).alias("hub"), F.lit(None).cast("long").alias("label"))
        of = of.select(F.col("_key").alias("b"), "hub", F.coalesce("label", "_key").alias("comp_b"))
        best = (now.join(hubs, "tok").groupBy(F.col("_key").alias("a"), "comp", "hub").agg(F.count("*").alias("common"))
                .join(of, "hub").where("comp <> comp_b")
                .groupBy("a").agg(F.max_by("b", "common").alias("b")))
        if not join_up(_verified(stored(best, "pairs"), classes, similarity)):
            break

    now = live()
    size = now.groupBy("tok", "comp").count()
    most = stored(size.groupBy("tok").agg(F.count("*").alias("comps"), F.max_by("comp", "count").alias("major")).where("comps > 1")
                  .select("tok", "major"), "major")
    mixed = stored(now.join(most, "tok"), "mixed")
    side = lambda x: [F.col("_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", "alone", "at", *BITS)]]
    few = mixed.where("comp <> major").select("tok", *side("a"))
    every = mixed.select("tok", *side("b"), (F.col("comp") == F.col("major")).alias("big"))
    # Length filter, and the positional one: if this is the first token that a
    # pair shares, what stands behind it on either side must reach the overlap.
    # It is met at a linked pair's first shared token, wherever that is.
    fits = ((100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
            & ((100 + similarity) * (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")))
               >= similarity * (F.col("n_a") + F.col("n_b"))))
    # Bitmap filter: a bit that only one side has stands for a token that only
    # it has, and so does every unshared token; a linked pair differs in few.
    apart = F.col("alone_a") + F.col("alone_b")
    for c in BITS:
        apart = apart + F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    fits = fits & ((100 + similarity) * apart <= (100 - similarity) * (F.col("n_a") + F.col("n_b")))
    pairs = (few.join(every, "tok").where("comp_a <> comp_b and (big or a < b)").where(fits)
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    join_up(_verified(stored(pairs, "pairs"), classes, similarity))
    if comp is None:
        return classes.select(F.col("_key").alias("v"), F.col("_key").alias("label")).limit(0)
    return comp


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                       similarity: int = SIMILARITY, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    keyed_docs, is_id = keyed(docs, id_col)
    members, classes = prefixes(keyed_docs.select("_key", text_or_empty(text_col).alias("text")), size, similarity)
    comp = link(classes, similarity, star_rounds)
    out = (members.join(comp, members["rep"] == comp["v"], "left")
           .select("_key", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("comp")))
    if is_id:
        return out.select(F.col("_key").alias(id_col), "n_shingles", F.col("comp").alias("component_id"))
    ids = keyed_docs.select("_key", id_col)
    return (out.join(ids, "_key").join(ids.select(F.col("_key").alias("comp"), F.col(id_col).alias("component_id")), "comp")
            .select(id_col, "n_shingles", "component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                     similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; blank texts all stay."""
    rows, _ = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "id")
    members, classes = prefixes(rows.select("_key", text_or_empty().alias("text")), size, similarity)
    comp = link(classes, similarity)
    first = (members.join(comp, members["rep"] == comp["v"], "left")
             .where(F.coalesce("label", "rep") == F.col("_key")).select("_key"))
    return with_texts(rows).join(stored(first, "near-first"), "_key", "left_semi").select("row.*")
