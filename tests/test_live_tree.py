"""A manifest from a live directory tree: filters, kinds, hashes."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from briefloom.operators.manifest import scan_manifest
from briefloom.sources import tree
from briefloom.sources.tree import manifest_from_tree


def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_manifest_from_tree(spark):
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    files = {
        "src/main.go": b"package main\n", "README.md": b"# hi\n", "node_modules/x/a.js": b"x",
        "dist/b.js": b"y", "img/logo.png": b"\x89PNG", "web/app.min.js": b"z", "go.sum": b"s",
        "big/huge.txt": b"a" * (2 << 20), "docs/Makefile": b"all:\n", "Vendor/v.go": b"v",
    }
    for rel, data in files.items():
        _write(root, rel, data)
    m = scan_manifest(manifest_from_tree(spark, root, "p1"))
    got = {r.relative_path: (r.kind, r.hash) for r in m.collect()}
    assert set(got) == {"src/main.go", "README.md", "docs/Makefile"}
    assert got["src/main.go"] == ("source", hashlib.sha256(b"package main\n").hexdigest())
    assert got["docs/Makefile"][0] == "config"
    big = os.path.join(root, "big/huge.txt")
    one = scan_manifest(manifest_from_tree(spark, big, "p1")).collect()
    assert [(r.relative_path, r.size, r.hash) for r in one] == [("huge.txt", 2 << 20, hashlib.sha256(b"a" * (2 << 20)).hexdigest())]


def test_hidden_underscore_and_empty_files_stay_and_links_do_not(spark):
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    kept = ["pkg/__init__.py", "pkg/__main__.py", ".env", ".gitignore", "_build.md", "empty.go", "a.go"]
    for rel in [*kept, ".git/config", "node_modules/deep/er/x.js"]:
        _write(root, rel, b"" if rel == "empty.go" else rel.encode())
    os.symlink(os.path.join(root, "a.go"), os.path.join(root, "link.go"))
    os.symlink(os.path.join(root, "pkg"), os.path.join(root, "linked"))
    listed = manifest_from_tree(spark, root, "p1")
    assert {os.path.relpath(r.path, root) for r in listed.collect()} == set(kept)
    got = {r.relative_path: r.hash for r in scan_manifest(listed).collect()}
    assert got == {rel: hashlib.sha256(b"" if rel == "empty.go" else rel.encode()).hexdigest() for rel in kept}


def _sorted(reader):
    rows = []
    for part in reader.partitions():
        for b in reader.read(part):
            rows += b.column("path").to_pylist()
    assert len(rows) == len(set(rows))
    return sorted(rows)


def test_unreadable_folders_and_files_stop_nothing(monkeypatch):
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    for rel in ("a/x.go", "a/locked/y.go", "b/z.go", "b/gone.go", "c.go"):
        _write(root, rel, b"1")
    scandir = os.scandir

    class Vanishing:
        def __init__(self, entry):
            self.entry, self.name, self.path = entry, entry.name, entry.path

        def __getattr__(self, name):
            return getattr(self.entry, name)

        def stat(self, **kw):
            if self.name == "gone.go":
                raise FileNotFoundError(self.path)
            return self.entry.stat(**kw)

    class Guarded:
        def __init__(self, folder):
            if str(folder).endswith("locked"):
                raise PermissionError(folder)
            self.it = scandir(folder)

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.it.close()

        def __iter__(self):
            return (Vanishing(e) for e in self.it)

    monkeypatch.setattr(tree.os, "scandir", Guarded)
    want = sorted(os.path.join(root, r) for r in ("a/x.go", "b/z.go", "c.go"))
    assert _sorted(tree.TreeReader(root, 64)) == want  # opened by the planner
    assert _sorted(tree.TreeReader(root, 1)) == want  # walked by a task


def test_a_locked_folder(spark):
    """Under a user whom permissions bind."""
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    _write(root, "open/a.go", b"1")
    _write(root, "locked/b.go", b"1")
    locked = os.path.join(root, "locked")
    os.chmod(locked, 0)
    try:
        bound = not os.access(locked, os.R_OK)
        got = {os.path.relpath(r.path, root) for r in manifest_from_tree(spark, root, "p").collect()}
        assert got == ({"open/a.go"} if bound else {"open/a.go", "locked/b.go"})
    finally:
        os.chmod(locked, 0o700)


def test_a_file_that_vanishes_before_it_is_hashed(spark):
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    _write(root, "stays.go", b"1")
    _write(root, "goes.go", b"2")
    listed = tree.list_tree(spark, root)
    os.remove(os.path.join(root, "goes.go"))
    got = {os.path.basename(r.path): r.hash for r in tree.hashed(listed).collect()}
    assert got == {"stays.go": hashlib.sha256(b"1").hexdigest(), "goes.go": None}


def test_a_flat_folder_is_listed_and_hashed_by_several_tasks(spark):
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    for i in range(5000):
        with open(os.path.join(root, f"f{i}.go"), "w") as f:
            f.write(str(i))
    reader = tree.TreeReader(root, 64)
    parts = reader.partitions()
    assert len(parts) == 3 and all(isinstance(p, tree.Slice) for p in parts)
    assert min(sum(b.num_rows for b in reader.read(p)) for p in parts) > 1000
    assert max(b.num_rows for p in parts for b in reader.read(p)) <= tree.ROWS
    got = tree.hashed(tree.list_tree(spark, root)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    assert {r.path: r.hash for r in got} == {os.path.join(root, f"f{i}.go"): hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)}


def test_deep_trees_are_planned_by_folders():
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    want = [f"d{i}/e{j}/f.go" for i in range(5) for j in range(4)] + ["top.go"]
    for rel in want:
        _write(root, rel, b"1")
    for splits in (1, 4, 64):
        reader = tree.TreeReader(root, splits)
        assert _sorted(reader) == sorted(os.path.join(root, r) for r in want)
    assert sum(isinstance(p, tree.Subtree) for p in tree.TreeReader(root, 4).partitions()) >= 4
    assert tree.TreeReader(os.path.join(root, "d0/e0"), 4).partitions() == [tree.Slice(os.path.join(root, "d0/e0"), 0, 1)]


def test_an_empty_and_a_missing_root(spark):
    root = tempfile.mkdtemp(prefix="briefloom-tree-")
    assert manifest_from_tree(spark, root, "p").count() == 0
    with pytest.raises(FileNotFoundError):
        manifest_from_tree(spark, os.path.join(root, "none"), "p")
