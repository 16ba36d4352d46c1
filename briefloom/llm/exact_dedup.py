"""Exact deduplication by deterministic block naming (native).

White space is deleted, the rest cut into blocks of ``block`` code points.
The distinct blocks are sorted and numbered; then adjacent pairs of numbers
are numbered again, level by level, until each document has one number.  At
each level two numbers are equal only if what they name is equal, so the last
number and its level identify the normalised text without collisions.

Blocks are shuffled once, to be numbered.  Documents then find their numbers
by a 64-bit hash of the block; that is exact for each hash with one distinct
block, which the numbering counts, and all others are joined on their text.

Defined cases: null text is empty; empty texts form one group; repeated rows
and null ids count as rows of their own (see ``common.keyed``); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import SPACE, keyed, stored, text_or_empty

BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def _numbered(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """Integer names of distinct rows: sorted within hash partitions."""
    return (distinct.distinct().sortWithinPartitions(*cols)
            .withColumn("name", F.monotonically_increasing_id()))


def _first_names(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(_key, pos, m, name) of each block; ``blocks`` has (_key, pos, h, block)."""
    names = stored(_numbered(blocks.select("h", "block"), ["h", "block"])
                   .groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name")), "names")
    plain = rows.join(names.where("n = 1").select("h", "name"), "h").select("_key", "pos", "m", "name")
    shared = names.where("n > 1").select("h")
    if shared.isEmpty():
        return plain
    texts = stored(blocks.join(shared, "h", "left_semi"), "blocks")
    again = stored(_numbered(texts.select("h", "block"), ["h", "block"]), "names")
    by_text = (texts.join(again, ["h", "block"]).select("_key", "pos", "name")
               .join(rows.select("_key", "pos", "m"), ["_key", "pos"]).select("_key", "pos", "m", "name"))
    top = names.agg(F.max("name")).first()[0]
    return plain.unionByName(by_text.withColumn("name", F.col("name") + F.lit(top + 1)))


def identities(keyed_docs: DataFrame, text_col: str = "text", block: int = BLOCK,
               hashed=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(facts, ids): facts has a row for each document, ids its (level, name).

    ``hashed`` finds a block's number again; any function gives the same
    groups (tests use a weak one).
    """
    norm = normalised(text_or_empty(text_col))
    parts = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    blocks = (keyed_docs.select("_key", F.posexplode(parts).alias("pos", "block"))
              .withColumn("h", hashed("block")))
    facts = stored(keyed_docs.select(
        "_key", F.length(text_or_empty(text_col)).alias("n_chars"),
        F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        F.transform(parts, lambda b: hashed(b)).alias("hs")), "facts")
    rows = facts.select("_key", F.size("hs").alias("m"), F.posexplode("hs").alias("pos", "h"))

    empty = facts.where(F.size("hs") == 0).select("_key", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))
    done, level = [empty], 0
    state = stored(_first_names(blocks, rows), "level")
    while True:
        done.append(state.where("m = 1").select("_key", F.lit(level).alias("level"), "name"))
        longer = state.where("m > 1")
        if longer.isEmpty():
            break
        pairs = stored(
            longer.groupBy("_key", "m", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                 F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r"))
            .withColumn("r", F.coalesce("r", F.lit(-1).cast("long"))), "pairs")
        names = stored(_numbered(pairs.select("l", "r"), ["l", "r"]), "names")
        state = stored(pairs.join(names, ["l", "r"])
                       .select("_key", "pos", F.expr("(m + 1) div 2").cast("int").alias("m"), "name"), "level")
        level += 1
    ids = done[0]
    for d in done[1:]:
        ids = ids.unionByName(d)
    return facts, ids


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original (in code points) stays, then the
    smallest id.
    """
    rows, is_id = keyed(docs, id_col)
    facts, ids = identities(rows, text_col, block, hashed)
    named = stored(facts.select("_key", "n_chars", "text_sha256").join(ids, "_key"), "named")
    groups = stored(
        named.groupBy("level", "name", "n_chars").agg(F.min("_key").alias("k"), F.count("*").alias("n"))
        .groupBy("level", "name").agg(F.max_by("k", "n_chars").alias("keep"), F.sum("n").alias("group_size")),
        "groups")
    out = named.join(groups, ["level", "name"])
    if is_id:
        out = out.withColumn(id_col, F.col("_key")).withColumn("keep_id", F.col("keep"))
    else:
        of = rows.select("_key", id_col)
        out = (out.join(of, "_key")
               .join(of.select(F.col("_key").alias("keep"), F.col(id_col).alias("keep_id")), "keep"))
    return out.select(id_col, "keep_id", "group_size", (F.col("_key") == F.col("keep")).alias("kept"), "text_sha256")
