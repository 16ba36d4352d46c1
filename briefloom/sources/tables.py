"""Readers for the Parquet tables and raw files the jobs consume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.schemas import HOOK_PAYLOAD


BUCKETS = 64


def project_bucket(project_id, buckets: int = BUCKETS) -> Column:
    """The bucket of a project's rows in a table that ``jobs.append_rows`` writes."""
    return F.pmod(F.xxhash64(F.col(project_id) if isinstance(project_id, str) else project_id), F.lit(buckets)).cast("int")


def read_project(spark: SparkSession, table_dir: str, project_id: str | None, buckets: int = BUCKETS) -> DataFrame:
    """One project's rows of such a table; only its bucket is listed and read."""
    key = F.lit(project_id).cast("string")
    return (spark.read.parquet(table_dir).where((F.col("bucket") == project_bucket(key, buckets)) & F.col("project_id").eqNullSafe(key))
            .drop("bucket", "run"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one string; ``source`` is the file path."""
    df = spark.read.text(path, wholetext=True)
    return df.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:", "").alias("source"),
        F.col("value").alias("raw_text"),
    )


def read_hook_payloads(spark: SparkSession, path: str) -> DataFrame:
    """S6 input: one JSON hook payload per line."""
    return (spark.read.schema(HOOK_PAYLOAD).option("mode", "PERMISSIVE")
            .json(path))
