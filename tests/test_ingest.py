"""Corpus ingest invariants: counters add up, a second run skips everything,
the snapshot keeps every key once, and input order never changes results."""

from pyspark.sql import functions as F

from briefloom.operators import diff as D
from briefloom.operators.manifest import incremental_scan, scan_manifest
from briefloom.sources import fixtures as fx
from conftest import SF_SMALL


def test_counters_add_up(spark):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL))
    diff = D.diff_documents(scanned, fx.previous_documents(spark, SF_SMALL))
    c = D.ingest_counters(diff).agg(F.sum("new"), F.sum("updated"), F.sum("skipped"), F.sum("errors")).first()
    assert sum(c) == scanned.count()
    assert all(n > 0 for n in c)


def test_second_run_skips_everything(spark):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL))
    first = D.diff_documents(scanned, fx.previous_documents(spark, SF_SMALL), include_missing=True)
    snapshot = D.next_document_snapshot(first, "2024-06-01 00:00:00")
    again = D.diff_documents(scanned, snapshot, include_missing=True)
    statuses = {r.status for r in again.select("status").distinct().collect()}
    assert statuses <= {"skipped", "missing", "error"}
    # ids are stable across runs
    ids1 = {tuple(r) for r in first.where("status != 'missing'").select("relative_path", "id").collect()}
    ids2 = {tuple(r) for r in again.where("status != 'missing'").select("relative_path", "id").collect()}
    assert ids1 == ids2


def test_snapshot_one_row_per_key_and_keeps_summary(spark):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL))
    prev = fx.previous_documents(spark, SF_SMALL)
    snap = D.next_document_snapshot(D.diff_documents(scanned, prev, include_missing=True), "2024-06-01 00:00:00")
    assert snap.count() == snap.select("project_id", "relative_path").distinct().count()
    updated = (D.diff_documents(scanned, prev).where("status = 'updated'")
               .select("project_id", "relative_path", "prev_summary"))
    j = updated.join(snap, ["project_id", "relative_path"]).where(F.col("summary") != F.col("prev_summary"))
    assert j.count() == 0


def test_order_insensitive(spark):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL))
    prev = fx.previous_documents(spark, SF_SMALL)
    a = D.diff_documents(scanned, prev).select("relative_path", "status", "id")
    b = D.diff_documents(scanned.repartition(7).orderBy(F.rand(3)), prev.repartition(3)).select(
        "relative_path", "status", "id")
    assert sorted(a.collect()) == sorted(b.collect())


def test_duplicate_relative_path_smallest_path_wins(spark):
    rows = [("p", "/a/x.md", "x.md", "markdown", "h1", 1), ("p", "/b/x.md", "x.md", "markdown", "h2", 1)]
    scanned = spark.createDataFrame(rows, "project_id string, path string, relative_path string, kind string, "
                                          "hash string, size bigint").withColumn(
        "mtime", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    prev = fx.previous_documents(spark, SF_SMALL).limit(0)
    d = D.diff_documents(scanned, prev).collect()
    assert len(d) == 1 and d[0].path == "/a/x.md" and d[0].status == "new"


def test_incremental_scan_advances_to_last_taken(spark):
    ts = "timestamp_ntz"
    files = spark.createDataFrame(
        [("f", f"/d/{i}.md", f"2024-01-01 00:0{i}:00") for i in range(8)] + [("g", "/g/a.md", "2024-01-01 00:00:00"),
                                                                              ("g", "/g/b.json", "2024-01-01 00:00:00"),
                                                                              ("g", "/g/c.log", "2024-01-01 00:00:00")],
        "folder string, path string, mtime string").withColumn("mtime", F.col("mtime").cast(ts))
    marks = spark.createDataFrame([("f", "2024-01-01 00:01:00")], "folder string, hwm string").withColumn(
        "hwm", F.col("hwm").cast(ts))
    taken, new_marks = incremental_scan(files, marks)
    t = sorted((r.folder, r.path) for r in taken.collect())
    assert t == [("f", f"/d/{i}.md") for i in range(2, 7)] + [("g", "/g/b.json")]
    m = {r.folder: str(r.hwm) for r in new_marks.collect()}
    assert m["f"] == "2024-01-01 00:06:00"


def test_incremental_scan_takes_every_file_of_one_mtime(spark):
    files = spark.createDataFrame([("f", f"/d/{i}.md") for i in range(8)], "folder string, path string").withColumn(
        "mtime", F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'"))
    marks = spark.createDataFrame([("f", "2024-01-01")], "folder string, hwm string").withColumn("hwm", F.col("hwm").cast("timestamp_ntz"))
    seen = []
    for _ in range(3):
        taken, marks = incremental_scan(files, marks)
        seen.append(sorted(r.path for r in taken.collect()))
    assert seen == [[f"/d/{i}.md" for i in range(5)], [f"/d/{i}.md" for i in range(5, 8)], []]


def test_unreadable_files_and_empty_roots(spark):
    rows = [("p", "/r1", "/r1/a.go", "h1"), ("p", "/r1", "/r1/b.go", None), ("p", "/r1", "/r1/c.go", None)]
    scanned = scan_manifest(spark.createDataFrame([(*r, 5) for r in rows], "project_id string, root string, path string, hash string, size bigint")
                            .withColumn("mtime", F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")))
    prev = fx.previous_documents(spark, SF_SMALL).limit(1).withColumn("project_id", F.lit("p")).withColumn("relative_path", F.lit("b.go"))
    diff = D.diff_documents(scanned, prev, include_missing=True)
    assert {r.relative_path: r.status for r in diff.collect()} == {"a.go": "new", "b.go": "error", "c.go": "error"}
    assert sorted(r.relative_path for r in D.next_document_snapshot(diff, "2024-06-01 00:00:00").collect()) == ["a.go", "b.go"]
    assert D.ingest_counters(diff).first()["errors"] == 2
    roots = spark.createDataFrame([("p", "/r1"), ("p", "/r2")], "project_id string, root string")
    got = {r.summary for r in D.ingest_sessions(D.ingest_counters(diff, "root"), roots).collect()}
    assert len(got) == 2 and any("1 new" in s for s in got) and any("0 new" in s for s in got)


def test_single_file_ingest_bypasses_filters(spark):
    rows = [("p", "/w/p/img.png", "/w/p/img.png", 10), ("p", "/w/p", "/w/p/img.png", 10),
            ("p", "/w/p/.git/x.go", "/w/p/.git/x.go", 10), ("p", "/w/p/big.go", "/w/p/big.go", 5 << 20)]
    files = spark.createDataFrame(rows, "project_id string, root string, path string, size bigint")
    got = sorted((r.path, r.relative_path) for r in scan_manifest(files).collect())
    assert got == [("/w/p/.git/x.go", "x.go"), ("/w/p/big.go", "big.go"), ("/w/p/img.png", "img.png")]


def test_explicit_ingest_rejects_empty_text(spark):
    from briefloom.operators.extraction import normalize_outputs
    outs = fx.coding_outputs(spark, SF_SMALL)
    empty = outs.limit(1).withColumn("raw_text", F.lit("")).withColumn("id", F.lit("empty"))
    both = outs.unionByName(empty)
    resp = fx.extraction_responses(spark, SF_SMALL)
    assert normalize_outputs(both, resp).count() == outs.count() + 1
    assert normalize_outputs(both, resp, reject_empty=True).count() == outs.count()


def test_archive_name(spark):
    from briefloom.streaming.inbox import archive_name
    df = spark.createDataFrame([("/in/a.md",), ("/in/noext",), ("/in/x.tar.gz",)], "p string")
    assert [r[0] for r in df.select(archive_name("p", 7)).collect()] == ["a-7.md", "noext-7", "x.tar-7.gz"]


def test_one_answer_per_request(spark):
    from briefloom.operators.extraction import one_answer, parse_extractions
    rows = [("r1", "o1", None, "timeout"), ("r1", "o1", '{"goal": "g"}', ""), ("r2", "o2", "x", "boom"),
            ("r2", "o2", None, "boom")]
    resp = spark.createDataFrame(rows, "request_id string, output_id string, content string, error string")
    one = {r.request_id: (r.content, r.error) for r in one_answer(resp).collect()}
    assert one == {"r1": ('{"goal": "g"}', ""), "r2": ("x", "boom")}
    p = {r.request_id: (r.ok, r.goal) for r in parse_extractions(resp).collect()}
    assert p == {"r1": (True, "g"), "r2": (False, "")}


def test_outputs_from_whole_texts(spark):
    import os
    import tempfile

    from briefloom.operators.extraction import normalize_outputs, outputs_from_texts
    from briefloom.sources.tables import read_whole_texts
    d = tempfile.mkdtemp(prefix="briefloom-texts-")
    for name, text in [("a.md", "Goal line\nnext: x"), ("b.txt", "plain")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    texts = read_whole_texts(spark, d).withColumn("project_id", F.lit("p1"))
    o1 = outputs_from_texts(texts, "batch-1", "2024-06-01 00:00:00")
    o2 = outputs_from_texts(texts, "batch-1", "2024-06-01 00:00:00")
    assert sorted(r.id for r in o1.collect()) == sorted(r.id for r in o2.collect())
    o3 = outputs_from_texts(texts, "batch-2", "2024-06-01 00:00:00")
    assert not {r.id for r in o1.collect()} & {r.id for r in o3.collect()}
    resp = spark.createDataFrame([], "request_id string, output_id string, content string, error string")
    n = normalize_outputs(o1, resp, reject_empty=True)
    assert sorted(r.raw_text for r in n.collect()) == ["Goal line\nnext: x", "plain"]


def test_dedupe_previous_keeps_oldest_row(spark):
    scanned = scan_manifest(fx.current_scan(spark, SF_SMALL))
    prev = fx.previous_documents(spark, SF_SMALL)
    dup = prev.withColumn("id", F.concat(F.col("id"), F.lit("-dup"))).withColumn(
        "created_at", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).withColumn("hash", F.lit("other"))
    both = prev.unionByName(dup)
    a = D.diff_documents(scanned, prev, include_missing=True).select("relative_path", "status", "id")
    b = D.diff_documents(scanned, both, include_missing=True, dedupe_previous=True).select(
        "relative_path", "status", "id")
    assert sorted(a.collect()) == sorted(b.collect())
