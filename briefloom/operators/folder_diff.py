"""Change detection in two levels: folders by digest, then the files of folders that differ.

A folder's digest does not depend on the order of its files: their number and
the sums of two hashes of (path, kind, digest, size).  Both sides are reduced
to one row a folder before anything is shuffled, the folders are compared, and
only files of folders that differ reach the join of files.  In a recurring
ingest most folders do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.operators.diff import diff_documents
from briefloom.session import materialize

FOLDER = ["project_id", "folder"]
_FILE = ["relative_path", "path", "kind", "hash", "size"]


def folder_of(relative_path) -> Column:
    """The folder of a relative path, '' for a file at the top."""
    path = F.col(relative_path) if isinstance(relative_path, str) else relative_path
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_digests(files: DataFrame) -> DataFrame:
    """(project_id, folder, n, d1, d2, unread): one row for each folder, by partial aggregation."""
    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(*_FILE, F.lit(seed)).cast("decimal(20,0)"))

    cols = [F.min("root").alias("root"), F.max("root").alias("root_max")] if "root" in files.columns else []
    return (files.withColumn("folder", folder_of("relative_path")).groupBy(*FOLDER)
            .agg(F.count("*").alias("n"), total(1).alias("d1"), total(2).alias("d2"), F.count_if(F.col("hash").isNull()).alias("unread"), *cols))


def compare_folders(scanned: DataFrame, previous: DataFrame) -> DataFrame:
    """(project_id, folder, same, root): every folder of either side.

    A folder is the same if both sides have the same files in it, by path,
    kind, digest and size, all of them could be read, and they come from one root.
    """
    now = folder_digests(scanned)
    one_root = F.col("root") == F.col("root_max") if "root" in now.columns else F.lit(True)
    root = F.col("root") if "root" in now.columns else F.lit(None).cast("string")
    before = folder_digests(previous.drop("root")).select(*FOLDER, *[F.col(c).alias(f"p_{c}") for c in ("n", "d1", "d2")])
    same = (F.col("n") == F.col("p_n")) & (F.col("d1") == F.col("p_d1")) & (F.col("d2") == F.col("p_d2")) & (F.col("unread") == 0) & one_root
    return now.join(before, FOLDER, "full").select(*FOLDER, F.coalesce(same, F.lit(False)).alias("same"), root.alias("root"))


def files_in(files: DataFrame, folders: DataFrame) -> DataFrame:
    """The files that lie in one of ``folders`` (project_id, folder)."""
    return files.withColumn("folder", folder_of("relative_path")).join(folders.select(*FOLDER), FOLDER, "left_semi").drop("folder")


def diff_by_folder(scanned: DataFrame, previous: DataFrame, include_missing: bool = False) -> DataFrame:
    """The rows of ``diff_documents``.

    Files of unchanged folders are ``skipped`` and come from the previous table
    alone: their columns are its own, with ``mtime`` the time it recorded.
    Rows whose key is null belong to no folder and are compared file by file.
    """
    folders = materialize(compare_folders(scanned, previous), "folders")
    # ``same`` is the smaller set to exclude by only if little changed: both ways are joins on folders.
    differ, same = folders.where("not same"), folders.where("same")
    changed = diff_documents(files_in(scanned, differ), files_in(previous, differ), include_missing=include_missing)
    keyless = F.col("project_id").isNull() | F.col("relative_path").isNull()
    loose = diff_documents(scanned.where(keyless), previous.where(keyless), include_missing=include_missing)
    kept = previous.withColumn("folder", folder_of("relative_path")).join(same.select(*FOLDER, "root"), FOLDER).drop("folder")
    own = {"path": "path", "kind": "kind", "hash": "hash", "size": "size", "mtime": "modified_at"}
    cols = [F.col(c) for c in ("project_id", "relative_path")]
    cols += [F.col("root")] if "root" in scanned.columns else []
    cols += [F.col(v).alias(k) for k, v in own.items()]
    cols += [F.col(c).alias(f"prev_{c}") for c in previous.columns if c not in ("project_id", "relative_path")]
    skipped = kept.select(*cols, F.lit("skipped").alias("status"), "id")
    return changed.unionByName(loose).unionByName(skipped.select(*changed.columns))
