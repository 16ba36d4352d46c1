"""Mixing sources to target weights by weighted fair queueing (native).

Each source's documents are shuffled by a hash of their id and queue behind
each other, a second time after the first (``epochs``).  A document's virtual
finish time is the source's words up to and with it, divided by the source's
weight.  All queues are range-sorted together by that time and cut where the
words reach the budget.  A source that runs out of epochs leaves its share to
the others, which is the water level that ``targets`` states in closed form.

Running sums never put a whole source in one task: its hash range is cut in
buckets of about ``BUCKET`` rows, whose sums are added up in two steps.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, last; null ids and repeated rows queue as rows of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom.llm.common import WORD, keyed, stored, text_or_empty, with_texts

WEIGHTS = (3, 1, 2)
RATIO = 1.5
EPOCHS = 2
BUCKET = 256
_BITS = 52


def targets(sources: DataFrame, weights=WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS) -> DataFrame:
    """Adds idx, w and target to (source, source_size, ...), a row for each source.

    The budget is ``ratio`` times all words.  A source is full at ``epochs``
    times its words; in the order of full / w the full ones come first, and
    the rest share what they leave by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = (sources.withColumn("idx", (F.row_number().over(by_name) - 1).cast("int"))
         .withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.col("idx") % len(weights) + 1))
         .withColumn("cap", F.col("source_size") * epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), "idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("budget", F.lit(ratio) * F.sum("source_size").over(everything))
         .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("share", F.col("left") / F.col("w_left"))
         .withColumn("full", F.col("cap") <= F.col("share") * F.col("w"))
         .withColumn("rest", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "idx", "share")))
                     .over(everything)["share"])
         .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double"))
                     .otherwise(F.col("rest") * F.col("w"))))
    return s.select(*sources.columns, "idx", "w", "budget", "target")


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights=WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS,
           bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(queue, sources): each document with ``done``, its source's words up to it."""
    rows, _ = keyed(docs, id_col)
    sized = stored(rows.select(
        "_key", F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.col("_key").cast("string").cast("binary")), 1, _BITS // 4), 16, 10)
        .cast("long").alias("u")), "sized")
    sources = stored(targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
        weights, ratio, epochs), "sources")
    # Null-safe equality on a plain equi-join: the flag tells null from "".
    on = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")]
    placed = stored(
        sized.select("*", *on).drop("source")
        .join(sources.select(*on, "idx", "n_docs"), ["s", "none"])
        .withColumn("bucket", F.floor(F.col("u") / F.lit(float(1 << _BITS)) * F.ceil(F.col("n_docs") / bucket)))
        .select("_key", "id", "size", "u", "idx", "bucket"), "placed")
    sums = stored(placed.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
                  .withColumn("part", F.expr(f"bucket div {bucket}")), "sums")
    before = lambda *part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = (sums.groupBy("idx", "part").agg(F.sum("words").alias("words"))
             .withColumn("part_from", F.coalesce(F.sum("words").over(before("idx", by="part")), F.lit(0)))
             .select("idx", "part", "part_from"))
    starts = stored(
        sums.withColumn("from", F.coalesce(F.sum("words").over(before("idx", "part", by="bucket")), F.lit(0)))
        .join(parts, ["idx", "part"])
        .select("idx", "bucket", (F.col("from") + F.col("part_from")).alias("from")), "starts")
    queue = Window.partitionBy("idx", "bucket").orderBy("u", "_key")
    q = placed.join(starts, ["idx", "bucket"]).withColumn("done", F.sum("size").over(queue) + F.col("from"))
    return stored(q.select("_key", "id", "idx", "size", "u", "done"), "queue"), sources


def cut(queue: DataFrame, sources: DataFrame, epochs: int = EPOCHS):
    """The last entry inside the budget as (finish, epoch, idx, u, _key), or None.

    Range-sorts all entries by virtual finish time; only the words of each
    range and the entries of the one range that holds the cut are looked at.
    """
    spark = queue.sparkSession
    entry = ["finish", "epoch", "idx", "u", "_key"]
    rounds = F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch")
    every = (queue.where("size > 0").select("*", rounds)
             .join(sources.select("idx", "w", "source_size"), "idx")
             .withColumn("finish", (F.col("done") + F.col("epoch") * F.col("source_size")) / F.col("w")))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(every.repartitionByRange(n, *entry).sortWithinPartitions(*entry)
                    .select(*entry, "size", F.spark_partition_id().alias("range")), "ranges")
    budget = sources.agg(F.max("budget")).first()[0] or 0.0
    at, before = None, 0
    for r in ranged.groupBy("range").agg(F.sum("size").alias("words")).orderBy("range").collect():
        at = r["range"]
        if before + r["words"] > budget:
            break
        before += r["words"]
    if at is None:
        return None
    upto = Window.orderBy(*entry).rowsBetween(Window.unboundedPreceding, 0)
    inside = (ranged.where(F.col("range") == at).withColumn("total", F.sum("size").over(upto) + F.lit(before))
              .where(F.col("total") <= F.lit(budget)))
    last = inside.orderBy(*[F.col(c).desc() for c in entry]).select(*entry).first()
    if last is None:
        last = (ranged.where(F.col("range") < at).orderBy(*[F.col(c).desc() for c in entry]).select(*entry).first())
    return last


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS, bucket: int = BUCKET) -> DataFrame:
    """One row per document with ``copies`` (times taken) and ``finish``, its first finish time.

    Columns: _key, id, size, idx, source_size, target, finish, copies, taken.
    """
    queue, sources = queued(docs, id_col, text_col, source_col, weights, ratio, epochs, bucket)
    last = cut(queue, sources, epochs)
    q = (queue.join(sources.select("idx", "w", "source_size", "target"), "idx")
         .withColumn("finish", F.col("done") / F.col("w")))
    copies = F.lit(0)
    if last is not None:
        for e in range(epochs):
            here = [(F.col("done") + e * F.col("source_size")) / F.col("w"), F.lit(e), F.col("idx"), F.col("u"), F.col("_key")]
            inside = F.lit(True)
            for mine, its in reversed(list(zip(here, last, strict=True))):
                inside = (mine < F.lit(its)) | ((mine == F.lit(its)) & inside)
            copies = copies + F.when(inside & (F.col("size") > 0), 1).otherwise(0)
    return (q.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
            .select("_key", "id", "size", "idx", "source_size", "target", "finish", "copies", "taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it."""
    rows, _ = keyed(docs.select(*[F.col(c).alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))],
                                F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "id")
    # Ordered by key, the mix of (_key, text, source) is the mix of the documents.
    taken = stored(mix(rows.select("_key", "text", "source"), "_key", "text", "source", weights, ratio, epochs)
                   .where("copies > 0").select("_key", "copies"), "mixed")
    return (with_texts(rows).join(taken, "_key")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
