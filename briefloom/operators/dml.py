"""Table writes expressed as snapshot transforms.

Plain Parquet has no MERGE: each write computes the next snapshot (or the
rows to append) with joins, and the caller writes it to a new folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.operators.resolve import ACTIVE_KEY, lookup_projects


def register_projects(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate projects (name, root_path, summary, created_at) with a
    status: ``created`` / ``name_required`` / ``duplicate_name``.

    A name must be non-empty and unique: it may not exist already, and among
    candidates with one name the earliest (then smallest root, then summary)
    is created; every other candidate comes back as a duplicate.  Created
    rows get a deterministic id and empty tag/goal lists.

    Identical candidates are counted first (partial aggregation) and come
    back as one row, or as the created one and one duplicate; ``n_candidates``
    says how many each row stands for.
    """
    cols = ["name", "root_path", "summary", "created_at"]
    groups = candidates.groupBy(*cols).agg(F.count("*").alias("_n"))
    winners = (groups.where(F.col("name") != "").groupBy("name")
               .agg(F.min(F.struct("created_at", "root_path", "summary")).alias("_w")))
    taken = existing.select(F.col("name").alias("_taken")).distinct()
    j = (groups.join(winners, "name", "left")
         .join(taken, F.col("name") == F.col("_taken"), "left"))
    wins = F.coalesce((F.col("name") != "") & F.col("_taken").isNull()
                      & (F.col("_w") == F.struct("created_at", "root_path", "summary")), F.lit(False))
    one = lambda status, n: F.struct(F.lit(status).alias("status"), n.cast("bigint").alias("n"))
    reported = F.filter(
        F.when(F.col("name") == "", F.array(one("name_required", F.col("_n"))))
        .when(wins, F.array(one("created", F.lit(1)), one("duplicate_name", F.col("_n") - 1)))
        .otherwise(F.array(one("duplicate_name", F.col("_n")))), lambda r: r["n"] > 0)
    out = j.withColumn("_r", F.explode(reported))
    return out.select(
        F.when(F.col("_r.status") == "created", F.sha2(F.concat(F.lit("project|"), F.col("name")), 256)).alias("id"),
        "name", "root_path", "summary",
        F.array().cast("array<string>").alias("tags"),
        F.array().cast("array<string>").alias("active_goals"),
        "created_at", F.col("created_at").alias("updated_at"),
        F.col("_r.status").alias("status"), F.col("_r.n").alias("n_candidates"),
    )


#: Columns of a project that a change may set.
CHANGEABLE = ("name", "root_path", "summary", "tags", "active_goals")


def update_projects(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """The next project snapshot and a status, ``updated`` or ``unchanged``.

    ``changes``: id, updated_at and any of ``CHANGEABLE``; a null leaves the
    value as it is.  The last change per id wins and bumps updated_at.  Every
    project comes back once, with all its columns; changes to unknown ids are
    in ``unknown_changes``.
    """
    new = [c for c in CHANGEABLE if c in changes.columns]
    last = changes.groupBy("id").agg(F.max_by(F.struct("updated_at", *new), F.struct("updated_at", *new)).alias("_c"))
    j = projects.join(last, "id", "left")
    cols = [F.coalesce(F.col(f"_c.{c}"), F.col(c)).alias(c) if c in new or c == "updated_at" else F.col(c)
            for c in projects.columns]
    return j.select(*cols, F.when(F.col("_c").isNotNull(), "updated").otherwise("unchanged").alias("status"))


def unknown_changes(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids that changes name and no project has: (id, error)."""
    return (changes.select("id").distinct().join(projects.select("id"), "id", "left_anti")
            .withColumn("error", F.lit("project not found")))


def use_project(keys: DataFrame, projects: DataFrame) -> DataFrame:
    """D7 + J5: settings rows that make each looked-up project the active one.

    ``keys``: (key, updated_at), a name or an id.  Returns (key, value,
    updated_at) to append to the settings log; unknown names write nothing.
    """
    found = lookup_projects(keys.select("key").distinct(), projects).where(F.col("project_id").isNotNull())
    return (keys.join(found.select("key", "project_id"), "key")
            .select(F.lit(ACTIVE_KEY).alias("key"), F.col("project_id").alias("value"), "updated_at"))


def delete_projects(ids: DataFrame, *tables: tuple[str, DataFrame, str]) -> list[DataFrame]:
    """Drop the given project ids and, like ON DELETE CASCADE, every row
    that points at them.  ``tables``: (name, df, project key column)."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return [df.join(gone, df[key] == gone["_gone"], "left_anti") for _, df, key in tables]
