"""Table-driven cases for the corpus filters and the kind classifier."""

from pyspark.sql import functions as F

from briefloom.functions import paths as P

DIR_CASES = [
    ("src", True), ("internal", True), ("node_modules", False), (".git", False), ("vendor", False),
    ("dist", False), (".vscode", False), (".idea", False), ("build", False),
    ("Vendor", False), (".", True),
]
FILE_CASES = [
    ("main.go", 1000, True), ("README.md", 500, True), ("config.yaml", 200, True),
    ("image.png", 5000, False), ("bundle.min.js", 1000, False), ("package-lock.json", 10000, False),
    ("go.sum", 5000, False), ("main.go", 2097152, False), ("binary.exe", 100, False),
    ("main.go", 1048576, True), ("IMAGE.PNG", 10, False), ("Go.sum", 10, True), ("x.pb.go", 10, False),
]
KIND_CASES = [
    ("main.go", "source"), ("app.ts", "source"), ("utils.py", "source"), ("README.md", "markdown"),
    ("notes.txt", "text"), ("config.yaml", "config"), ("docker-compose.yml", "config"),
    ("Makefile", "config"), ("image.png", "other"), ("README", "markdown"), ("readme.txt", "text"),
    (".env", "config"), ("prod.env.example", "config"), ("MAIN.GO", "source"), ("Dockerfile", "config"),
]


def test_dir_filter(spark):
    df = spark.createDataFrame(DIR_CASES, "name string, want boolean")
    got = df.select("name", "want", (~P.dir_is_ignored(F.col("name"))).alias("got")).collect()
    assert [(r.name, r.got) for r in got] == [(r.name, r.want) for r in got]


def test_file_filter(spark):
    df = spark.createDataFrame(FILE_CASES, "path string, size bigint, want boolean")
    got = df.select("path", "size", "want", P.passes_file_filter("path", "size").alias("got")).collect()
    assert [(r.path, r.size, r.got) for r in got] == [(r.path, r.size, r.want) for r in got]


def test_kind(spark):
    df = spark.createDataFrame(KIND_CASES, "path string, want string")
    got = df.select("path", "want", P.file_kind("path").alias("got")).collect()
    assert [(r.path, r.got) for r in got] == [(r.path, r.want) for r in got]


def test_relative_path_and_dir_filter(spark):
    rows = [("/r/src/a.go", "/r", "src/a.go", True), ("/r", "/r", "r", True),
            ("/x/y.go", "/r", "y.go", True), ("/r/.cache/a/b.go", "/r/", ".cache/a/b.go", False),
            ("/r/.hidden.md", "/r", ".hidden.md", True), ("/r/a/tmp/b.md", "/r", "a/tmp/b.md", False)]
    df = spark.createDataFrame(rows, "path string, root string, want string, keep boolean")
    got = df.select(P.relative_path("path", "root").alias("rel"), "want", "keep").select(
        "rel", "want", "keep", P.passes_dir_filter("rel").alias("got_keep")).collect()
    for r in got:
        assert r.rel == r.want and r.got_keep == r.keep


def test_default_project_name(spark):
    df = spark.createDataFrame([("/home/u/My Project",), ("/a/b/",)], "p string")
    assert [r[0] for r in df.select(P.default_project_name("p")).collect()] == ["my-project", "b"]


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    from briefloom.sources.tables import read_table
    path = str(tmp_path / "documents.parquet")
    spark.range(3).write.parquet(path)
    assert read_table(spark, str(tmp_path), "documents").count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert read_table(spark, f"{tmp_path}/", "documents").count() == 5
