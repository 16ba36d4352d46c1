"""Project writes: register, update, delete (cascade), settings."""

from pyspark.sql import functions as F

from briefloom.operators import dml


def _projects(spark):
    return spark.createDataFrame(
        [("a", "alpha", "/w/a", "", "2024-01-01 00:00:00"), ("b", "beta", "/w/b", "old", "2024-01-02 00:00:00")],
        "id string, name string, root_path string, summary string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))


def test_register_rules(spark):
    cand = spark.createDataFrame(
        [("gamma", "/g1", "", "2024-02-01 00:00:00"), ("gamma", "/g2", "", "2024-01-01 00:00:00"),
         ("alpha", "/x", "", "2024-01-01 00:00:00"), ("", "/blank", "", "2024-01-01 00:00:00"),
         ("delta", "/d", "", "2024-01-01 00:00:00"), ("delta", "/d", "", "2024-01-01 00:00:00")],
        "name string, root_path string, summary string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = sorted((r.name, r.root_path, r.status) for r in dml.register_projects(_projects(spark), cand).collect())
    assert got == [("", "/blank", "name_required"), ("alpha", "/x", "duplicate_name"),
                   ("delta", "/d", "created"), ("delta", "/d", "duplicate_name"),
                   ("gamma", "/g1", "duplicate_name"), ("gamma", "/g2", "created")]


def test_update_last_change_wins_and_unknown_ids(spark):
    ch = spark.createDataFrame([("b", "s1", "2024-03-01 00:00:00"), ("b", "s2", "2024-03-02 00:00:00"),
                                ("zz", "x", "2024-03-01 00:00:00")], "id string, summary string, updated_at string") \
        .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    projects = _projects(spark).withColumn("tags", F.array(F.lit("t"))).withColumn("active_goals", F.array(F.lit("g")))
    ch = ch.withColumn("name", F.when(F.col("summary") == "s2", "renamed")).withColumn("active_goals", F.array(F.col("summary")))
    done = dml.update_projects(projects, ch)
    assert done.columns == [*projects.columns, "status"]
    got = {r.id: (r.name, r.root_path, r.summary, r.tags, r.active_goals, r.status) for r in done.collect()}
    assert got == {"a": ("alpha", "/w/a", "", ["t"], ["g"], "unchanged"), "b": ("renamed", "/w/b", "s2", ["t"], ["s2"], "updated")}
    assert [tuple(r) for r in dml.unknown_changes(projects, ch).collect()] == [("zz", "project not found")]


def test_use_project_writes_the_active_setting(spark):
    keys = spark.createDataFrame([("beta", 1), ("a", 2), ("nobody", 3)], "key string, updated_at int")
    got = sorted((r.key, r.value, r.updated_at) for r in dml.use_project(keys, _projects(spark)).collect())
    assert got == [("active_project_id", "a", 2), ("active_project_id", "b", 1)]


def test_delete_cascades(spark):
    docs = spark.createDataFrame([("d1", "a"), ("d2", "b")], "id string, project_id string")
    ids = spark.createDataFrame([("a",)], "id string")
    kept_docs, kept_projects = dml.delete_projects(ids, ("documents", docs, "project_id"),
                                                   ("projects", _projects(spark), "id"))
    assert [r.id for r in kept_docs.collect()] == ["d2"]
    assert [r.id for r in kept_projects.collect()] == ["b"]
