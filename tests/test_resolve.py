"""Path resolution against a brute-force prefix search, and plan shape."""

from pyspark.sql import functions as F

from briefloom.operators import resolve as J
from briefloom.sources import fixtures as fx
from conftest import SF_CHECK


def _brute(cwds, projects):
    best = {}
    for c in cwds:
        cand = None
        for p in sorted(projects, key=lambda p: (p["created_at"], p["id"])):
            root = p["root_path"]
            if not root:
                continue
            root = root if root.endswith("/") else root + "/"
            if (c["cwd"] + "/").startswith(root) and (cand is None or len(root) > cand[0]):
                cand = (len(root), p["id"])
        best[c["cwd_id"]] = cand[1] if cand else None
    if len(projects) == 1:
        best = {k: projects[0]["id"] for k in best}
    return best


def test_detect_matches_brute_force(spark):
    cwds = fx.resolution_cwds(spark, SF_CHECK)
    projects = fx.resolution_projects(spark, SF_CHECK)
    got = {r.cwd_id: r.project_id for r in J.detect_projects(cwds, projects).collect()}
    want = _brute([r.asDict() for r in cwds.collect()], [r.asDict() for r in projects.collect()])
    assert got == want


def test_detect_plan_has_no_nested_loop_join(spark):
    df = J.detect_projects(fx.resolution_cwds(spark, SF_CHECK), fx.resolution_projects(spark, SF_CHECK))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_edge_roots(spark):
    projects = spark.createDataFrame(
        [("a", "/w", "2024-01-01"), ("b", "/w/", "2024-01-02"), ("c", "/w/x", "2024-01-03"), ("d", "", "2024-01-01"),
         ("e", "/", "2024-01-05")],
        "id string, root_path string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    cwds = spark.createDataFrame([(1, "/w/x/y"), (2, "/w/xy"), (3, "/w"), (4, "/q")], "cwd_id int, cwd string")
    got = {r.cwd_id: r.project_id for r in J.detect_projects(cwds, projects).collect()}
    assert got == {1: "c", 2: "a", 3: "a", 4: "e"}


def test_single_project_shortcut_and_modes(spark):
    projects = spark.createDataFrame([("only", "/elsewhere", "2024-01-01")], "id string, root_path string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    cwds = spark.createDataFrame([(1, "/nowhere")], "cwd_id int, cwd string")
    assert J.detect_projects(cwds, projects).first().project_id == "only"
    dangling = spark.createDataFrame([("active_project_id", "gone")], "key string, value string")
    a = J.resolve_projects(cwds, projects, dangling, "active_first").first()
    assert a.project_id is None and a.error == "active project not found"
    b = J.resolve_projects(cwds, projects, dangling, "detect_first").first()
    assert b.project_id == "only" and b.resolved_by == "detected"


def test_latest_setting_wins(spark):
    log = spark.createDataFrame([("k", "v1", "2024-01-01"), ("k", "v2", "2024-01-02"), ("j", "x", "2024-01-01")],
                                "key string, value string, updated_at string")
    got = {r.key: r.value for r in J.latest_settings(log).collect()}
    assert got == {"k": "v2", "j": "x"}
