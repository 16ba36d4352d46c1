"""The inbox job over real files: empty files, dead letters, re-drops, restarts, crashes, archive;
and the dedupe of streams that carry contents."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from briefloom.sources.inbox import InboxReader, OffsetLog
from briefloom.streaming import inbox as I
from briefloom.streaming import watch as W

AT = "2024-06-01 00:00:00"


def _drop(d, name, text, mode="w"):
    tmp = os.path.join(os.path.dirname(d), "." + name + ".tmp")
    with open(tmp, mode) as f:
        f.write(text)
    os.rename(tmp, os.path.join(d, name))  # writers land files by atomic rename


def _places():
    root = tempfile.mkdtemp(prefix="briefloom-inbox-")
    out = [os.path.join(root, x) for x in ("inbox", "out", "ckpt")]
    os.makedirs(os.path.join(out[0], "processed"))
    return out


def _run(spark, places, **kw):
    q = W.watch_inbox(spark, *places, "p1", AT, **kw)
    q.awaitTermination()
    return q


def _table(spark, places, name):
    return spark.read.parquet(os.path.join(places[1], name))


def _names(rows, col="source"):
    return sorted(os.path.basename(r[col]) for r in rows)


def test_files_empty_ones_too_are_stored_asked_for_and_archived(spark):
    places = _places()
    for name, text in [("a.md", "alpha"), ("b.txt", "bravo"), ("c.json", "{}"), ("d.log", ""), ("e.MD", "upper"), ("f.pdf", "x"), (".md", "hidden")]:
        _drop(places[0], name, text)
    _drop(places[0], "g.md", b"caf\xff", "wb")
    _drop(os.path.join(places[0], "processed"), "old.md", "archived")
    _run(spark, places)
    outputs = _table(spark, places, "coding_outputs").collect()
    assert {os.path.basename(r.source): r.raw_text for r in outputs} == {
        "a.md": "alpha", "b.txt": "bravo", "c.json": "{}", "d.log": "", ".md": "hidden", "g.md": "caf�"}
    assert {r.project_id for r in outputs} == {"p1"}
    requests = _table(spark, places, "llm_requests").collect()
    assert {r.output_id for r in requests} == {r.id for r in outputs}
    sessions = _table(spark, places, "session_entries").collect()
    assert {r.summary for r in sessions} == {f"coding output from {r.source}" for r in outputs}
    rejects = _table(spark, places, "inbox_rejects").collect()
    assert [(os.path.basename(r.path), r.reason) for r in sorted(rejects, key=lambda r: r.path)] == [
        ("e.MD", W.UNSUPPORTED), ("f.pdf", W.UNSUPPORTED)]
    assert sorted(os.listdir(places[0])) == ["e.MD", "f.pdf", "processed"]
    assert sorted(os.listdir(os.path.join(places[0], "processed"))) == [
        "-0.md", "a-0.md", "b-0.txt", "c-0.json", "d-0.log", "g-0.md", "old.md"]

    # A restart takes the new file alone and repeats neither outputs nor rejects.
    _drop(places[0], "h.md", "hotel")
    _run(spark, places)
    assert _names(_table(spark, places, "coding_outputs").collect()) == [".md", "a.md", "b.txt", "c.json", "d.log", "g.md", "h.md"]
    assert _table(spark, places, "inbox_rejects").count() == 2


def test_a_name_dropped_twice_is_stored_once_and_archived_twice(spark):
    places = _places()
    _drop(places[0], "a.md", "one")
    _run(spark, places)
    _drop(places[0], "a.md", "two")
    _run(spark, places)
    assert [r.raw_text for r in _table(spark, places, "coding_outputs").collect()] == ["one"]
    assert [(os.path.basename(r.path), r.reason) for r in _table(spark, places, "inbox_rejects").collect()] == [("a.md", W.SEEN)]
    done = os.path.join(places[0], "processed")
    assert {n: open(os.path.join(done, n)).read() for n in os.listdir(done)} == {"a-0.md": "one", "a-1.md": "two"}


class LosesFiles(W.InboxSink):
    """One file is gone between the decision and the reading."""

    def store(self, batch, batch_id):
        for r in batch.where(F.col("path").endswith("gone.md")).collect():
            os.remove(r.path)
        super().store(batch, batch_id)


def test_one_bad_file_is_a_dead_letter_and_the_others_are_stored(spark):
    places = _places()
    for name in ("a.md", "gone.md", "z.md"):
        _drop(places[0], name, name)
    _run(spark, places, sink=LosesFiles)
    assert _names(_table(spark, places, "coding_outputs").collect()) == ["a.md", "z.md"]
    assert [(os.path.basename(r.path), r.reason) for r in _table(spark, places, "inbox_rejects").collect()] == [("gone.md", "read: No such file or directory")]
    _run(spark, places)
    assert _table(spark, places, "inbox_rejects").count() == 1 and _table(spark, places, "coding_outputs").count() == 2


class CrashesBeforeMoves(W.InboxSink):
    def archive(self, spark, batch_id):
        raise RuntimeError("crash")


class CrashesAfterMoves(W.InboxSink):
    def archive(self, spark, batch_id):
        super().archive(spark, batch_id)
        raise RuntimeError("crash")


class CrashesWhileStoring(W.InboxSink):
    def store(self, batch, batch_id):
        super().store(batch.limit(1), batch_id)
        for name in os.listdir(self._path("archive_intents", batch_id)):
            os.remove(os.path.join(self._path("archive_intents", batch_id), name))
        raise RuntimeError("crash")


@pytest.mark.parametrize("sink", [CrashesBeforeMoves, CrashesAfterMoves, CrashesWhileStoring])
def test_a_crash_is_mended_by_the_restart(spark, sink):
    places = _places()
    _drop(places[0], "a.md", "alpha")
    _drop(places[0], "b.md", "bravo")
    with pytest.raises(Exception, match="crash"):
        _run(spark, places, sink=sink)
    if sink is CrashesBeforeMoves:
        assert os.path.exists(os.path.join(places[0], "a.md"))
        _drop(places[0], "b.md", "dropped anew before its predecessor was moved")
    _run(spark, places)  # ends with the mended batch
    _run(spark, places)
    outputs = _table(spark, places, "coding_outputs").collect()
    assert sorted(r.raw_text for r in outputs) == ["alpha", "bravo"]
    done = sorted(os.listdir(os.path.join(places[0], "processed")))
    if sink is CrashesBeforeMoves:
        # the newer b.md was never taken for the older one: it is a later arrival of a path already taken
        moved = {os.path.basename(r.src): (r.moved, r.reason) for r in spark.read.parquet(os.path.join(places[1], "archived", "batch=0")).collect()}
        assert moved == {"a.md": (True, None), "b.md": (False, "changed")}
        assert done == ["a-0.md", "b-1.md"]
    else:
        assert done == ["a-0.md", "b-0.md"]
    assert os.listdir(places[0]) == ["processed"]


def test_contents_are_in_no_exchange(spark):
    places = _places()
    df = W.decide(W.read_inbox(spark, places[0], places[2] + "/log"))
    assert df.isStreaming and "raw_text" not in df.columns and "content" not in df.columns
    assert not {"raw_text", "content"} & set(W.read_inbox(spark, places[0], places[2] + "/log").columns)


def test_a_horizon_forgets_old_paths(spark):
    places = _places()
    _drop(places[0], "a.md", "one")
    _run(spark, places, horizon_seconds=1)
    time.sleep(2)
    _drop(places[0], "b.md", "moves the watermark")
    _run(spark, places, horizon_seconds=1)
    _drop(places[0], "a.md", "two")
    _run(spark, places, horizon_seconds=1)
    assert sorted(r.raw_text for r in _table(spark, places, "coding_outputs").collect()) == ["moves the watermark", "one", "two"]


def test_the_offset_log(tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    reader = InboxReader(str(inbox), str(tmp_path / "log"), 0.0)
    assert reader.latestOffset() == {"n": 0}
    (inbox / "a.md").write_text("1")
    (inbox / "empty.md").write_text("")
    (inbox / "sub").mkdir()
    one = reader.latestOffset()
    assert one == {"n": 1} == reader.latestOffset()
    (inbox / "b.md").write_text("22")
    two = reader.latestOffset()

    def names(start, end, r=reader):
        return [os.path.basename(p) for part in r.partitions(start, end) for b in r.read(part) for p in b.column("path").to_pylist()]

    assert sorted(names({"n": 0}, one)) == ["a.md", "empty.md"] and names(one, two) == ["b.md"]
    # Another process sees the same listings, before and after a commit.
    again = InboxReader(str(inbox), str(tmp_path / "log"), 0.0)
    assert again.latestOffset() == two and names(one, two, again) == ["b.md"]
    os.remove(inbox / "a.md")
    again.commit(one)
    again.commit(one)
    assert sorted(os.listdir(tmp_path / "log")) == ["known-000000000001.json", "listing-000000000002.json"]
    assert len(json.loads((tmp_path / "log" / "known-000000000001.json").read_text())) == 1
    assert reader.latestOffset() == two
    (inbox / "a.md").write_text("1, dropped again")
    assert names(two, reader.latestOffset()) == ["a.md"]
    assert OffsetLog(str(tmp_path / "none")).known() == set()


def test_a_folder_that_is_gone_stops_nothing(tmp_path):
    reader = InboxReader(str(tmp_path / "none"), str(tmp_path / "log"), 0.0)
    assert reader.latestOffset() == {"n": 0}
    assert [b.num_rows for p in reader.partitions({"n": 0}, {"n": 0}) for b in reader.read(p)] == [0]


def test_the_project_of_an_inbox(spark):
    projects = (spark.createDataFrame([("p1", "one", "/w/one"), ("p2", "two", "/w/two")], "id string, name string, root_path string")
                .withColumn("created_at", F.lit(AT).cast("timestamp_ntz")))
    active = spark.createDataFrame([("active_project_id", "p2")], "key string, value string")
    none = active.limit(0)
    assert W.inbox_project(projects, active, "/w/one/sub") == "p1"
    assert W.inbox_project(projects, active, "/elsewhere") == "p2"
    assert W.inbox_project(projects, none, "/elsewhere", "two") == "p2"
    for key in ("", "three"):
        with pytest.raises(ValueError):
            W.inbox_project(projects, none, "/elsewhere", key)


def test_dedupe_of_a_stream_with_contents(spark):
    root = tempfile.mkdtemp(prefix="briefloom-arrivals-")
    src, out, ckpt = (os.path.join(root, x) for x in ("src", "out", "ckpt"))
    schema = "arrival_id long, path string, content string, arrived_at timestamp_ntz, project_id string"
    rows = [(1, "/i/a.md", "alpha"), (2, "/i/b.json", "{}"), (3, "/i/c.pdf", "x"), (4, "/i/a.md", "alpha")]
    (spark.createDataFrame(rows, "arrival_id long, path string, content string")
     .select("*", F.lit(AT).cast("timestamp_ntz").alias("arrived_at"), F.lit("p1").alias("project_id")).write.parquet(src))
    for horizon in (None, "1 hour"):
        dest = f"{out}-{horizon}"
        I.run_inbox(spark.readStream.schema(schema).parquet(src), dest, f"{ckpt}-{horizon}", AT, horizon=horizon).awaitTermination()
        assert _names(spark.read.parquet(os.path.join(dest, "outputs")).collect()) == ["a.md", "b.json"]
        assert spark.read.parquet(os.path.join(dest, "sessions")).count() == 2
