"""Incremental scoring of submissions that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (method, record_id, score) rows from CSV files dropped in a folder."""
    return spark.readStream.schema("method string, record_id string, score double").option("header", True).csv(path)


def coverage(stream: DataFrame) -> DataFrame:
    """Scores received per method so far."""
    return stream.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("missing"))
