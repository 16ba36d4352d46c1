"""Row places, folder digests, durable marks, summaries, token scoring and project buckets against the plain ways."""

import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from briefloom.functions import levels as L
from briefloom.operators import context as C
from briefloom.operators import diff as D
from briefloom.operators import folder_diff as FD
from briefloom.operators import summary as S
from briefloom.operators.manifest import scan_manifest
from briefloom.plans import jobs
from briefloom.sources import fixtures as fx
from briefloom.sources.tables import project_bucket, read_project
from conftest import SF_SMALL

T0 = "2024-01-01 00:00:00"


def _plan(df):
    return df._jdf.queryExecution().toString()


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ------------------------------------------------------------- newest N
def _windowed(df, n, time_col):
    w = Window.partitionBy("project_id").orderBy(F.col(time_col).desc(), F.col("id").desc())
    return df.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= n)


def test_newest_keeps_null_projects_and_repeated_rows(spark, tmp_path):
    rows = [(p, i, f"2024-01-{1 + d:02d}", "x" * 50) for p, i, d in [
        ("a", "1", 1), ("a", "1", 1), ("a", "1", 1), ("a", "2", 1), ("a", "3", 0), (None, "4", 5), (None, "5", 4), (None, None, 4),
        ("b", None, 2), ("b", None, 2), ("b", "6", 1), ("c", "7", 0)]] + [("b", "8", None, None)]
    df = spark.createDataFrame(rows, "project_id string, id string, at string, text string").withColumn("at", F.to_timestamp_ntz("at"))
    df.repartition(3).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for n in (1, 2, 3, 10):
        want = _rows(_windowed(df, n, "at"), *df.columns, "recency_rank")
        for frame in (table, df, table.where("true").select("*"), table.unionByName(table.limit(0))):
            got = C.newest_per_project(frame, n, "at")
            assert got.columns == [*df.columns, "recency_rank"]
            assert _rows(got, *df.columns, "recency_rank") == want


def test_newest_sorts_places_and_fetches_texts_for_the_winners(spark):
    docs = fx.context_documents(spark, SF_SMALL)
    plan = _plan(C.recent_doc_summaries(docs, 3))
    assert "_at_row" in plan and "WindowGroupLimit" in plan
    # a frame whose rows repeat a table's row has no place of its own for each
    twice = docs.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
    assert C._located(twice) is None and C._located(docs.union(docs)) is None
    want = _rows(_windowed(twice, 2, "modified_at"), "project_id", "id", "recency_rank")
    assert _rows(C.newest_per_project(twice, 2, "modified_at"), "project_id", "id", "recency_rank") == want


# --------------------------------------------------------- folder digests
COLS = ["project_id", "relative_path", "status", "id", "root", "path", "kind", "hash", "size"]


def _snapshot(spark, scanned):
    return D.next_document_snapshot(D.diff_documents(scanned, fx.previous_documents(spark, SF_SMALL), include_missing=True), T0)


@pytest.mark.parametrize("missing", [False, True])
def test_folder_diff_equals_file_diff(spark, missing):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL))
    for prev in (fx.previous_documents(spark, SF_SMALL), _snapshot(spark, scanned), fx.previous_documents(spark, SF_SMALL).limit(0)):
        want = D.diff_documents(scanned, prev, include_missing=missing)
        got = FD.diff_by_folder(scanned, prev, include_missing=missing)
        assert set(got.columns) == set(want.columns)
        present = "status <> 'missing'"
        plain = [c for c in COLS if c != "root"]
        assert _rows(got, *plain) == _rows(want, *plain)
        assert _rows(got.where(present), *COLS) == _rows(want.where(present), *COLS)
        assert _rows(D.ingest_counters(got.where(present), "root"), "*") == _rows(D.ingest_counters(want.where(present), "root"), "*")


def test_only_folders_that_differ_reach_the_file_join(spark):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL)).where(F.col("hash").isNotNull())
    prev = _snapshot(spark, scanned)
    prev = prev.join(scanned.select("project_id", "relative_path"), ["project_id", "relative_path"], "left_semi")
    touched = "src1/"
    one = scanned.select("project_id", FD.folder_of("relative_path").alias("folder")).distinct().orderBy("project_id", "folder").first()
    here = (F.col("project_id") == one.project_id) & (FD.folder_of("relative_path") == one.folder)
    now = scanned.withColumn("hash", F.when(here, F.concat(F.lit(touched), "hash")).otherwise(F.col("hash")))
    folders = FD.compare_folders(now, prev)
    assert _rows(folders.where("not same"), "project_id", "folder") == [(one.project_id, one.folder)]
    read = FD.files_in(now, folders.where("not same"))
    assert 0 < read.count() == now.where(here).count() < now.count() / 10
    got = FD.diff_by_folder(now, prev)
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {
        "updated": read.count(), "skipped": now.count() - read.count()}


def test_a_folder_with_two_files_for_one_key_or_an_unread_file_is_compared(spark):
    rows = [("p", "/a", "/a/d/x.md", "d/x.md", "markdown", "h1", 1), ("p", "/b", "/b/d/x.md", "d/x.md", "markdown", "h2", 1),
            ("p", "/a", "/a/e/y.md", "e/y.md", "markdown", None, 1), (None, "/n", "/n/z.md", "z.md", "markdown", "h", 1)]
    scanned = (spark.createDataFrame(rows, "project_id string, root string, path string, relative_path string, kind string, hash string, size long")
               .withColumn("mtime", F.lit(T0).cast("timestamp_ntz")))
    prev = D.next_document_snapshot(D.diff_documents(scanned, fx.previous_documents(spark, SF_SMALL).limit(0), include_missing=True), T0)
    want, got = D.diff_documents(scanned, prev, include_missing=True), FD.diff_by_folder(scanned, prev, include_missing=True)
    assert _rows(got, "project_id", "relative_path", "status") == _rows(want, "project_id", "relative_path", "status")


# ------------------------------------------------------------------ marks
def _files(spark, n=23):
    return spark.createDataFrame([("f", f"/f/{i:03d}.md", f"2024-01-01 00:{i // 4:02d}:00") for i in range(n)] + [("g", "/g/a.log", T0), ("g", "/g/b.json", T0)],
                                 "folder string, path string, mtime string").withColumn("mtime", F.to_timestamp_ntz("mtime"))


def test_runs_and_a_crash_between_them_lose_and_repeat_nothing(spark, tmp_path):
    marks, out = f"{tmp_path}/marks", f"{tmp_path}/out"
    first = spark.createDataFrame([("f", "2023-01-01 00:00:00")], "folder string, hwm string").withColumn("hwm", F.to_timestamp_ntz("hwm"))
    files = _files(spark)

    def run(i):
        return _rows(spark.read.parquet(jobs.incremental_export(spark, files, marks, out, f"r{i}", first)["exported_files"]), "path")

    one = run(1)
    assert len(one) == 6  # five of f; g has no mark: its last path with a first extension
    two = run(2)
    shutil.rmtree(f"{marks}/run=r2")  # as if it had broken off before its marks were out
    assert run(2) == two
    three = run(3)
    assert run(2) == two and run(1) == one and run(3) == three  # made again after later ones
    rest = [run(i) for i in (4, 5, 6)]
    taken = [p for batch in (one, two, three, *rest) for (p,) in batch]
    assert sorted(p for p in taken if p.startswith("/f")) == [f"/f/{i:03d}.md" for i in range(23)]
    assert len(taken) == len(set(taken)) and rest[-1] == []


# -------------------------------------------------------------- summaries
def test_bundles_from_summaries_equal_those_of_the_history(spark, tmp_path):
    outputs, sessions = fx.coding_outputs(spark, SF_SMALL), fx.session_entries(spark, SF_SMALL)
    documents, projects = fx.context_documents(spark, SF_SMALL), fx.context_projects(spark, SF_SMALL)
    limits = (L.MAX_CONTEXT_OUTPUTS, L.MAX_CONTEXT_SESSIONS, L.MAX_CONTEXT_DOCS)
    want = sorted(map(str, C.context_bundles(projects, outputs, sessions, documents, *limits).collect()))
    base = str(tmp_path)
    for i in range(4):
        part = F.pmod(F.xxhash64("id"), F.lit(4)) == i
        S.write_summary(outputs.where(part), "outputs", base, f"r{i}")
        S.write_summary(sessions.where(part), "sessions", base, f"r{i}")
        S.write_summary(documents if i else documents.limit(3), "documents", base, f"r{i}")
        S.write_summary(outputs.where(part), "outputs", base, f"r{i}")  # made again
        if i == 2:
            S.compact(spark, "outputs", base, "r2")
    got = S.context_from_summaries(spark, projects, base, *limits)
    assert sorted(map(str, got.collect())) == want
    assert all(f"{base}/outputs/" in f for f in S.read_summary(spark, "outputs", base).inputFiles())
    most = S.read_summary(spark, "outputs", base).groupBy("project_id").count().agg(F.max("count")).first()[0]
    assert most <= 2 * S.KEPT["outputs"][2]
    with pytest.raises(ValueError):
        S.context_from_summaries(spark, projects, base, 99, 1, 1)


# ---------------------------------------------------------- token scoring
def test_token_scores_equal_whole_text_scores(spark):
    documents = fx.context_documents(spark, SF_SMALL)
    words = [w for r in documents.limit(5).collect() for w in r.summary.split()[:12]]
    projects = [r[0] for r in documents.select("project_id").distinct().collect()]
    goals = [" ".join(words[i:i + 7] * (1 + i % 3)) for i in range(0, 40, 3)] + ["", "the and", "zzzz"]
    req = spark.createDataFrame([(f"{p}-{i}", p, g, 1 + i % 15) for p in [*projects[:6], "nowhere", None] for i, g in enumerate(goals)],
                                "request_id string, project_id string, goal string, doc_limit int")
    cols = ["request_id", "doc_id", "score", "recency_rank", "relevance_rank"]
    got, want = C.rank_documents_by_token(req, documents), C.rank_documents(req, documents)
    assert _rows(got, *cols) == _rows(want, *cols)
    assert got.columns == want.columns and any(r.score > 1 for r in got.collect())


# ---------------------------------------------------------------- buckets
def test_a_listing_reads_its_bucket_and_a_rerun_replaces_its_own(spark, tmp_path):
    sessions = fx.session_entries(spark, SF_SMALL)
    table = f"{tmp_path}/sessions"
    extra = sessions.limit(3).withColumn("project_id", F.lit(None).cast("string"))
    jobs.append_rows(sessions, table, "r1")
    jobs.append_rows(extra, table, "r2")
    jobs.append_rows(sessions, table, "r1")
    assert spark.read.parquet(table).count() == sessions.count() + 3
    project = sessions.groupBy("project_id").count().orderBy(F.desc("count"), "project_id").first().project_id
    own = read_project(spark, table, project)
    assert _rows(own, *sessions.columns) == _rows(sessions.where(F.col("project_id") == project), *sessions.columns)
    bucket = spark.range(1).select(project_bucket(F.lit(project))).first()[0]
    line = next(x for x in _plan(own).splitlines() if "PartitionFilters" in x)
    assert f"= {bucket})" in line.split("PartitionFilters:")[1].split("]")[0]
    assert read_project(spark, table, None).count() == 3
    listing = C.recent_sessions(own, L.LISTING_CAP)
    assert _rows(listing, "id", "recency_rank") == _rows(C.recent_sessions(sessions, L.LISTING_CAP).where(F.col("project_id") == project), "id", "recency_rank")
