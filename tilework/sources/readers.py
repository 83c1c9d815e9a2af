"""Readers for the pipeline's inputs; all return DataFrames and infer nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilework.functions.columns import strip
from tilework.functions.sequences import normal


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def ragged_csv(spark: SparkSession, path: str, columns: Sequence[str], short_rows: str = "pad") -> DataFrame:
    """All-string CSV with a header. Short rows are padded with empty cells, or skipped if ``short_rows`` is ``skip``."""
    df = spark.read.schema(_strings(columns)).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    if short_rows == "skip":
        return df.where(F.col(columns[-1]).isNotNull())
    return df.select([F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in columns])


def string_csv(spark: SparkSession, path: str, casts: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header as strings, then casts by column; what does not parse is null."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()})


def split_files(spark: SparkSession, paths: Mapping[str, str], schema: str) -> DataFrame:
    """Files of splits as one table with ``split``."""
    out = None
    for split, path in paths.items():
        part = spark.read.schema(schema).option("header", True).csv(path).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def gzip_dictionary(spark: SparkSession, path: str, partitions: int = 32) -> DataFrame:
    """A compressed CSV (which one task reads), dealt out again."""
    return spark.read.option("header", True).csv(path).repartition(partitions)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``accession, header, sequence`` of FASTA files."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    header = F.regexp_replace(F.regexp_extract("value", r"^>?([^\n]*)", 1), "\r", "")
    body = F.regexp_replace(F.regexp_replace(F.col("value"), r"^[^\n]*\n?", ""), r"\s", "")
    rows = raw.where(F.trim("value") != "").select(F.trim(header).alias("header"), normal(body).alias("sequence"))
    return rows.select(F.regexp_extract("header", r"^>?\s*(\S+)", 1).alias("accession"), "header", "sequence")


def accession_map(spark: SparkSession, path: str) -> DataFrame:
    """``source, accession`` from a JSON object name -> {accessions: [...]}."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("accessions", T.ArrayType(T.StringType()))]))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    return text.select(F.explode("m").alias("source", "v")).select("source", F.explode("v.accessions").alias("accession"))


def gene_map(spark: SparkSession, path: str) -> DataFrame:
    """``source, accession`` from a JSON object gene -> {acc, status}; only mapped genes, keyed ``human_<gene>``."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("acc", T.StringType()), T.StructField("status", T.StringType())]))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    rows = text.select(F.explode("m").alias("gene", "v")).where(F.col("v.status").isin("ok", "partial") & F.col("v.acc").isNotNull())
    return rows.select(F.concat(F.lit("human_"), "gene").alias("source"), F.col("v.acc").alias("accession"))


def submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_id string, score double").option("header", True).csv(path)


def canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prior_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """Metric tables written before, as one."""
    return spark.read.option("mergeSchema", True).parquet(*paths)
