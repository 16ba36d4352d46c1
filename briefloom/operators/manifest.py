"""Corpus manifest: filter, classify and key files (S1-S3, F1-F5, P1, P2),
and the incremental high-water-mark scan (S7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions import paths as P


def document_key(project_id, relative_path) -> Column:
    """Deterministic document id: a retry of the same ingest yields the same id."""
    return F.sha2(F.concat_ws("|", F.col(project_id) if isinstance(project_id, str) else project_id,
                              F.col(relative_path) if isinstance(relative_path, str) else relative_path), 256)


def scan_manifest(files: DataFrame, max_size_bytes: int = P.DEFAULT_MAX_SIZE_BYTES) -> DataFrame:
    """Keep the files a directory walk would ingest and attach kind and
    relative path.

    ``files`` needs ``root``, ``path``, ``size`` and optionally ``is_symlink``.
    A row whose path *is* its root is a single-file ingest (S2): it bypasses
    every filter.  One narrow ``where`` + ``select``: no shuffle, and the
    size predicate is pushed to the Parquet scan when ``files`` comes
    straight from one.
    """
    single = F.col("path") == F.col("root")
    cond = P.passes_file_filter("path", "size", max_size_bytes)
    if "is_symlink" in files.columns:
        cond = ~F.col("is_symlink") & cond
    rel = P.relative_path("path", "root")
    return (files.where(single | cond)
            .withColumn("relative_path", rel)
            .where(single | P.passes_dir_filter("relative_path"))
            .withColumn("kind", P.file_kind("path")))


def content_hash(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """SHA-256 hex digest of each text."""
    return texts.withColumn("hash", F.sha2(F.col(text_col), 256))


def incremental_scan(files: DataFrame, marks: DataFrame, first_exts=(".md", ".json"),
                     next_exts=(".md", ".json", ".log"), batch: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per folder, the files to export since its high-water mark, and the new marks.

    ``files``: (folder, path, mtime).  ``marks``: (folder, hwm, hwm_path), the
    last file taken; files with one mtime follow each other by path, so a
    batch border between them loses none.  A mark without a path (null) stands
    behind all files of its mtime.
    With a mark: files behind it with a ``next_exts`` extension, oldest first
    (path breaks ties), at most ``batch``; the mark advances to the last one
    taken, so files beyond the batch are picked up next run.
    Without a mark: the single last path (descending) with a ``first_exts``
    extension, which becomes the mark.
    Returns (taken files with ``ord``, new marks).
    """
    ext = P.extension("path")
    if "hwm_path" not in marks.columns:
        marks = marks.withColumn("hwm_path", F.lit(None).cast("string"))
    j = files.join(marks, "folder", "left")
    has_mark = F.col("hwm").isNotNull()
    behind = (F.col("mtime") > F.col("hwm")) | ((F.col("mtime") == F.col("hwm")) & (F.col("path") > F.col("hwm_path")))
    cand = j.where((has_mark & behind & ext.isin(list(next_exts))) | (~has_mark & ext.isin(list(first_exts))))
    w = Window.partitionBy("folder").orderBy(
        F.when(has_mark, F.col("mtime")).asc_nulls_last(),
        F.when(has_mark, F.col("path")).asc_nulls_last(),
        F.when(~has_mark, F.col("path")).desc_nulls_last(),
    )
    # a plain rank bound first, so Spark trims each folder before the shuffle
    ranked = cand.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= max(batch, 1))
    taken = ranked.where(has_mark | (F.col("ord") == 1))
    taken = taken.select("folder", "path", "mtime", F.col("ord").cast("bigint").alias("ord"))
    last = F.max(F.struct("mtime", "path")).alias("m")
    new_marks = (taken.groupBy("folder").agg(last)
                 .select("folder", F.col("m.mtime").alias("hwm"), F.col("m.path").alias("hwm_path"))
                 .unionByName(marks.join(taken.select("folder").distinct(), "folder", "left_anti")
                              .select("folder", "hwm", "hwm_path")))
    return taken, new_marks
