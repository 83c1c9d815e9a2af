"""Writers; a table that is being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def metric_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON object per key, the other columns nested under ``metrics``."""
    df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("metrics")).write.json(path)


def rewritten(spark: SparkSession, path: str, version: int, change) -> DataFrame:
    """A changed copy of ``<path>/v<version>`` as the next version."""
    change(spark.read.parquet(f"{path}/v{version}")).write.parquet(f"{path}/v{version + 1}")
    return spark.read.parquet(f"{path}/v{version + 1}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file under a path (files up to Spark's binary limit of 2 GB)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
