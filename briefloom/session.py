"""Spark session and shared-storage helpers.

Every job in the package takes a ``SparkSession`` from the caller; this
module only offers a sensible default builder (tests, bench) and a way to
find the shared checkpoint folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "briefloom") -> SparkSession:
    """Local/default session with AQE on and the UI off."""
    master = master or os.environ.get("BRIEFLOOM_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("BRIEFLOOM_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BRIEFLOOM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str, unique: bool = True) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The directory comes from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  Only when neither is set in a local run do we create
    one, and we register it on the context so ``checkpoint()`` works; on a
    cluster executors could not share it, so a missing setting is an error.
    With ``unique=False`` the folder name is ``purpose`` itself, so a re-run
    of the same step overwrites its own intermediate.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        try:
            base = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001 -- no SparkContext (Spark Connect)
            base = None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="briefloom-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(base)
        except Exception:  # noqa: BLE001
            pass
    base = base.rstrip("/")
    suffix = f"-{uuid.uuid4().hex[:12]}" if unique else ""
    return f"{base}/briefloom/{purpose}{suffix}"


def local_path(path: str) -> str:
    """A mounted path as Python's file functions take it (``file:`` taken off)."""
    if path.startswith("file:"):
        path = path[5:]
        return "/" + path.lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not in a mounted folder")
    return path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
