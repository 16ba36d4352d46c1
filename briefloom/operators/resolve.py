"""Path -> project resolution and project lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: settings key of the active project.
ACTIVE_KEY = "active_project_id"


def _root_key(root: Column) -> Column:
    """A project root as the prefix it matches: always ending in '/'."""
    return F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))


def cwd_prefixes(cwd: Column) -> Column:
    """Every prefix of ``cwd + '/'`` that ends in '/'.

    A root R (ending in '/') is a prefix of cwd + '/' exactly when R is one
    of these, so the prefix test becomes an equi-join on an exploded column
    instead of a nested-loop join.  The array length is the path depth.
    """
    s = F.concat(cwd, F.lit("/"))
    parts = F.split(s, "/")
    # prefix ending at the i-th '/' = the first i parts joined, plus '/'
    return F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )


def detect_projects(cwds: DataFrame, projects: DataFrame) -> DataFrame:
    """J2 + J3 for many cwds at once.

    ``cwds``: (cwd_id, cwd).  ``projects``: (id, root_path, created_at, ...).
    Returns (cwd_id, cwd, project_id) -- project_id NULL when nothing matches.
    Longest root wins; equal roots go to the earliest created (then id).
    Empty roots never match.  When the store holds exactly one project it is
    returned for every cwd.
    """
    roots = (projects.where(F.col("root_path") != "")
             .select(F.col("id").alias("project_id"), _root_key(F.col("root_path")).alias("prefix"),
                     "created_at"))
    # Every absolute path has the prefix "/": it would be one hot key.  A root
    # "/" holds them all, so it is a scalar that stands behind other matches.
    top = (roots.where(F.col("prefix") == "/")
           .agg(F.min_by("project_id", F.struct("created_at", "project_id")).alias("id")).scalar())
    paths = cwds.select("cwd").distinct()
    exploded = (paths.select("cwd", F.explode(cwd_prefixes(F.col("cwd"))).alias("prefix"))
                .where(F.col("prefix") != "/"))
    rank = F.struct(-F.length("prefix"), F.col("created_at"), F.col("project_id"))
    found = (exploded.join(roots.where(F.col("prefix") != "/"), "prefix")
             .groupBy("cwd").agg(F.min_by("project_id", rank).alias("detected")))
    best = (cwds.select("cwd_id", "cwd").join(found, "cwd", "left")
            .withColumn("detected", F.coalesce("detected", F.when(F.col("cwd").startswith("/") | (F.col("cwd") == ""), top))))
    # Exactly one project -> that project for every cwd.  One scalar
    # subquery (evaluated once, then used as a literal): no join needed.
    store = projects.agg(F.struct(F.count("*").alias("n"), F.min("id").alias("only_id"))).scalar()
    n_projects, only_id = store["n"], store["only_id"]
    out = (best
           .select("cwd_id", "cwd",
                   F.when(n_projects == 1, only_id).otherwise(F.col("detected")).alias("project_id")))
    return out


def latest_settings(log: DataFrame) -> DataFrame:
    """Last write wins per key over an append-only settings log."""
    return log.groupBy("key").agg(
        F.max_by("value", F.struct("updated_at", "value")).alias("value"),
        F.max("updated_at").alias("updated_at"),
    )


def active_project(settings: DataFrame, projects: DataFrame) -> tuple[Column, Column]:
    """(active_id, active_exists) from one scalar subquery (evaluated once,
    then used as literals); active_id is NULL when the setting is unset or
    blank.  ``settings`` holds one row per key (see ``latest_settings``)."""
    a = (settings.where((F.col("key") == ACTIVE_KEY) & (F.col("value") != ""))
         .select(F.col("value").alias("active_id")))
    ids = projects.select(F.col("id").alias("active_id"), F.lit(True).alias("_found"))
    info = (a.join(ids, "active_id", "left")
            .agg(F.struct(F.max("active_id").alias("id"),
                          F.coalesce(F.max("_found"), F.lit(False)).alias("found")))
            .scalar())
    return info["id"], info["found"]


MODES = ("active_first", "detect_first")


def _resolve(det: DataFrame, active_id: Column, exists: Column, mode: Column, keep=()) -> DataFrame:
    """Apply a resolution mode (a column, so one pass can carry both)."""
    j = det.withColumn("active_id", active_id)
    has_active = F.col("active_id").isNotNull()
    active_ok = has_active & exists
    detected = F.col("project_id").isNotNull()
    first = mode == "active_first"
    pid = (F.when(first, F.when(active_ok, F.col("active_id")).when(has_active, F.lit(None))
                  .otherwise(F.col("project_id")))
           .otherwise(F.when(detected, F.col("project_id")).when(active_ok, F.col("active_id"))))
    by = (F.when(first, F.when(active_ok, "active").when(has_active, F.lit(None)).when(detected, "detected"))
          .otherwise(F.when(detected, "detected").when(active_ok, "active")))
    err = (F.when(first, F.when(has_active & ~active_ok, "active project not found")
                  .when(~detected, "no project found"))
           .otherwise(F.when(~detected & ~active_ok, "no project found")))
    return j.select("cwd_id", "cwd", *keep, pid.alias("project_id"), by.alias("resolved_by"),
                    F.coalesce(err, F.lit("")).alias("error"))


def resolve_projects(cwds: DataFrame, projects: DataFrame, settings: DataFrame,
                     mode: str = "active_first") -> DataFrame:
    """Resolve each cwd to a project.

    mode ``active_first`` (ingest, brief, export, status): the active setting
    wins; an active id whose project is gone is an error, not a fallback.
    mode ``detect_first`` (inbox, hooks): directory detection, then active.
    Returns (cwd_id, cwd, project_id, resolved_by, error).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    active_id, exists = active_project(settings, projects)
    return _resolve(detect_projects(cwds, projects), active_id, exists, F.lit(mode))


def resolve_projects_all_modes(cwds: DataFrame, projects: DataFrame, settings: DataFrame) -> DataFrame:
    """J4 in both modes from one detection pass; adds ``mode``."""
    active_id, exists = active_project(settings, projects)
    det = detect_projects(cwds, projects).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    return _resolve(det, active_id, exists, F.col("mode"), keep=("mode",))


def lookup_projects(keys: DataFrame, projects: DataFrame) -> DataFrame:
    """J5 + F9: resolve each name-or-id key; id match first, then name.

    ``keys``: (key).  Returns (key, project_id, matched_by) with NULLs for
    not-found keys (kept so the caller can report them).
    """
    by_id = projects.select(F.col("id").alias("key"), F.col("id").alias("id_match"))
    # names are unique on registration; should a store hold a duplicate, the
    # oldest project keeps the name (bounded aggregate, no fan-out)
    by_name = (projects.groupBy(F.col("name").alias("key"))
               .agg(F.min_by("id", F.struct("created_at", "id")).alias("name_match")))
    j = keys.join(by_id, "key", "left").join(by_name, "key", "left")
    return j.select(
        "key",
        F.coalesce("id_match", "name_match").alias("project_id"),
        F.when(F.col("id_match").isNotNull(), "id").when(F.col("name_match").isNotNull(), "name")
        .otherwise("not_found").alias("matched_by"),
    )


def list_projects(projects: DataFrame, settings: DataFrame) -> DataFrame:
    """S8 + J6: projects oldest first with the active one flagged."""
    act = settings.where(F.col("key") == ACTIVE_KEY).select(F.col("value").alias("id"),
                                                             F.lit(True).alias("is_active"))
    return (projects.join(act, "id", "left")
            .select("id", "name", "root_path", "created_at",
                    F.coalesce("is_active", F.lit(False)).alias("is_active"))
            .orderBy("created_at", "id"))
