"""Helpers shared by the operators: table reads, stored intermediates, row keys.

Every operator takes a DataFrame of documents with any further columns and
works on ``_key``: a long that is unique and not null for each row.  Where
``doc_id`` already is one, it is the key; a table with null or repeated ids
is stored once, range-sorted by id (nulls last), under fresh keys in that
order, so "smallest id" and "smallest key" mean the same row.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.session import shared_dir

#: The white space of every contract here: blank and U+0009 to U+000D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

# Shuffle files of a finished write are dead once its result is stored.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_AT_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# For up to this many partitions each task of a shuffle opens a file for every one of them; for more it sorts them into one.
_FILES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_TABLES: dict[str, dict] = {}


def tables(owner: str) -> dict:
    """What this Python worker keeps from task to task for one operator.

    Workers outlive a stage and serve the next one too: what another operator
    kept here is dropped.
    """
    if owner not in _TABLES:
        _TABLES.clear()
        _TABLES[owner] = {}
    return _TABLES[owner]


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions as set, or a few more where a file for each in every task would cost more than what it holds."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 256 if 64 < n <= _FILES else n


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]):
    """Session settings that hold within this block."""
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _writing(spark: SparkSession):
    new = {_CLEANUP: "true"}
    if spark.conf.get(_AT_FIRST, None) is None:
        new[_AT_FIRST] = str(partitions(spark))
    return settings(spark, new)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with a file that every executor can read, so a lost
    executor costs a re-read and not a recomputation; the shuffle files of
    the write are dropped when it ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{purpose}")
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """``docs`` with ``_key``, and whether ``_key`` is the id itself."""
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        odd = (docs.groupBy(F.col(id_col).cast("long").alias("_key")).count()
               .where(F.col("_key").isNull() | (F.col("count") > 1)))
        if odd.isEmpty():
            return docs.withColumn("_key", F.col(id_col).cast("long")), True
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last())
    return stored(ordered.withColumn("_key", F.monotonically_increasing_id()), "keyed"), False


def with_texts(df: DataFrame) -> DataFrame:
    """Join ``df``, which carries whole texts, by sort-merge at every size.

    The other side grows with the corpus; were it broadcast while it is small,
    a small run would show nothing of the shuffle that a large one needs.
    """
    return df.hint("merge")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(v, label): the smallest vertex that edges (a, b) connect to v; ``known`` are the labels of edges before them.

    Each round hangs every vertex on its smallest neighbour, if that is smaller,
    and all on the ends of such chains. Only edges between different ends go on:
    a round has at most half the vertices of the one before.
    """
    def over(df: DataFrame, ends: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = (df.join(ends.select(F.col("v").alias(c), F.col("label").alias("_end")), c, "left")
                  .withColumn(c, F.coalesce("_end", c)).drop("_end"))
        return df

    def between(df: DataFrame) -> DataFrame:
        return stored(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    labels = None if known is None else known.where("v <> label").select("v", "label")
    edges = between(edges if labels is None else over(edges.select("a", "b"), labels, "a", "b"))
    while not edges.isEmpty():
        ends = stored(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("label")), "labels")
        while True:
            up = ends.select(F.col("v").alias("label"), F.col("label").alias("_up"))
            moved = stored(ends.join(up, "label", "left").select("v", F.coalesce("_up", "label").alias("label"),
                                                                 F.col("_up").isNotNull().alias("moved")), "labels")
            ends = moved.select("v", "label")
            if moved.where("moved").isEmpty():
                break
        labels = ends if labels is None else stored(over(labels, ends, "label").unionByName(ends), "labels")
        edges = between(over(edges, ends, "a", "b"))
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return stored(labels.unionByName(labels.select(F.col("label").alias("v"), "label").distinct()), "labels")
