"""One key holding a third of all rows: results stay whole and exact, and
the plans trim or pre-aggregate before the shuffle."""

from pyspark.sql import functions as F

from briefloom.operators import context as C
from briefloom.operators import diff as D
from briefloom.operators import resolve as J
from briefloom.operators.manifest import scan_manifest
from briefloom.sources import fixtures as fx
from conftest import SF_CHECK


def _hot(df, col="project_id", key="doc_id"):
    return df.withColumn(col, F.when(F.col(key).cast("bigint") % 3 == 0, F.lit("hot")).otherwise(F.col(col)))


def test_top_n_on_hot_project_matches_brute_force(spark):
    docs = _hot(fx.context_documents(spark, SF_CHECK).withColumn("doc_id", F.col("id")))
    got = C.recent_doc_summaries(docs, 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial (before the exchange) + final
    pdf = docs.where("summary != ''").toPandas()
    pdf = pdf.sort_values(["project_id", "modified_at", "id"], ascending=[True, False, False])
    want = {(r.project_id, r.id) for r in pdf.groupby("project_id").head(8).itertuples()}
    assert {(r.project_id, r.id) for r in got.collect()} == want
    assert sum(1 for p, _ in want if p == "hot") == 8


def test_diff_on_hot_project_is_whole(spark):
    cur = _hot(fx.current_scan(spark, SF_CHECK))
    prev = fx.previous_documents(spark, SF_CHECK)  # hot files are all new against it
    scanned = scan_manifest(cur)
    d = D.diff_documents(scanned, prev)
    assert d.count() == scanned.count()
    hot = d.where("project_id = 'hot'").count()
    assert hot == scanned.where("project_id = 'hot'").count() and hot > 0


def test_root_prefix_matching_every_cwd(spark):
    cwds = fx.resolution_cwds(spark, SF_CHECK)
    projects = fx.resolution_projects(spark, SF_CHECK).unionByName(
        spark.createDataFrame([("p-root", "root", "/"), ("p-hot", "hot", "/hot")], "id string, name string, root_path string")
        .withColumn("created_at", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")))
    got = J.detect_projects(cwds, projects)
    assert got.count() == cwds.count()
    assert got.where(F.col("project_id").isNull()).count() == 0
    # every cwd still goes to its longest root, not to the hot '/' root
    assert got.where("project_id = 'p-root'").count() == 0


def test_hot_prefix_join_is_split_by_aqe(spark):
    """A root every cwd shares makes one join key hot; with thresholds scaled
    down to the test size, AQE splits that partition (skew=true) and the
    result is unchanged."""
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in confs}
    projects = fx.resolution_projects(spark, SF_CHECK).unionByName(
        spark.createDataFrame([("p-root", "root", "/"), ("p-hot", "hot", "/hot")], "id string, name string, root_path string")
        .withColumn("created_at", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")))
    cwds = fx.resolution_cwds(spark, SF_CHECK).withColumn("cwd", F.concat(F.lit("/hot"), "cwd"))
    want = {r.cwd_id: "p-hot" for r in cwds.collect()}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        df = J.detect_projects(cwds.repartition(8), projects)  # several map tasks, as on a cluster
        got = {r.cwd_id: r.project_id for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got == want
    assert "SortMergeJoin(skew=true)" in plan
