"""The corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns the columns of ``documents``; the last returns the packed
pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm import toxicity
from briefloom.llm.common import stored, table
from briefloom.llm.jaccard_join import drop_near_copies
from briefloom.llm.line_dedup import line_dedup
from briefloom.llm.mixing import mixed
from briefloom.llm.packing import best_fit


def _narrow(docs: DataFrame) -> DataFrame:
    """Id and text, and the whole row under a name of its own: no column can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the grammar rejects; all others stay as they are.

    Null and empty texts score low and stay; repeated rows are judged alike;
    an empty table stays empty; own columns, ``score`` too, are passed on.
    """
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_narrow(docs), grammar).where("predicted = 0").select("_row.*")


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated lines; drops a document of which nothing but blank text is left.

    ``n_chars`` becomes the length of what is left (that of a null text stays);
    texts that were blank before stay; of repeated rows the first keeps its
    lines; an empty table stays empty; own columns, ``lines_dropped`` too, are
    passed on.
    """
    out = line_dedup(_narrow(docs))
    bare = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), F.lit("")) == ""
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.col("_row.n_chars")).cast("long")}
    return (out.where((F.col("lines_dropped") == 0) | ~bare)
            .select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]))


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Blank texts are no copies of each other and stay; of repeated rows one
    stays; an empty table stays empty; own columns are passed on.
    """
    return drop_near_copies(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix of sources takes; a document taken twice is there twice.

    Texts without words are never taken; a null source is one of its own;
    repeated rows count by themselves; an empty table stays empty.
    """
    return mixed(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null and empty texts are one token, an empty table packs to none."""
    return best_fit(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_copies", stage_near_copies),
    ("mix", stage_mix),
    ("pack", stage_pack),
]

# Learned scores, edit distances and token ids are beyond SQL; the tests hold
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
