"""Coordinates of records, attributions of sequences to targets, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tilework.functions.columns import coordinate_status


def with_coordinates(records: DataFrame, coordinates: DataFrame, observation: Observation | None = None, key: str = "record_id") -> DataFrame:
    """Records with the columns of their row of coordinates (of which ``source_accession`` tells whether there is one) and
    ``coordinate_status``; columns of the records that have one of these names go.

    The key must be unique among coordinates: the job that reads the result fails on a repeated one. ``observation`` gets ``keys``,
    ``most`` (rows of a key) without a second scan.
    """
    fields = [c for c in coordinates.columns if c != key]
    one = coordinates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*fields)).alias("_c"), F.count("*").alias("_n"))
    if observation is not None:
        one = one.observe(observation, F.count("*").alias("keys"), F.max("_n").alias("most"))
    unique = F.when(F.col("_n") == 1, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("more than one row of coordinates for "), F.col(key).cast("string"))))
    kept = records.drop(*fields, "coordinate_status")
    out = kept.join(one.select(key, unique.alias("_c")), key, "left").select(*kept.columns, "_c.*")
    return out.withColumn("coordinate_status", coordinate_status(F.col("source_accession")))


def unambiguous(attributed: DataFrame) -> DataFrame:
    """Rows with exactly one target in the array ``targets``."""
    return attributed.where(F.size("targets") == 1)


def audit(attributed: DataFrame) -> DataFrame:
    """``rows, targets, ambiguous, unmatched`` by split, category and match kind, by split, and over all (null keys).

    ``attributed`` has split, category, match and the array ``targets``, empty or null for what is not matched. Arrays are
    opened through the aggregation, a row counting once, at its first target.
    """
    keys = ["split", "category", "match"]
    size = F.size(F.coalesce("targets", F.array().cast(attributed.schema["targets"].dataType)))
    opened = attributed.select(*keys, size.alias("_size"), F.posexplode_outer("targets").alias("_at", "_target"))
    first = F.col("_at").isNull() | (F.col("_at") == 0)
    counts = [F.count_if(first).alias("rows"), F.countDistinct("_target").alias("targets"), F.count_if(first & (F.col("_size") > 1)).alias("ambiguous"), F.count_if(F.col("_at").isNull()).alias("unmatched")]
    return opened.groupingSets([keys, ["split"], []], *keys).agg(*counts)


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """How far two attributions of the same sequences agree: ``rows, found, category_rate, target_rate``.

    Rows of ``one`` meet all rows of ``other`` with the same sequence (a sequence that is in both several times fans out, and each
    meeting counts); rows that meet none are counted in ``rows`` only. Both have sequence, category and target.
    """
    right = other.select("sequence", F.col("category").alias("_category"), F.col("target").alias("_target"), F.lit(1).alias("_found"))
    both = one.select("sequence", "category", "target").join(right, "sequence", "left")
    same = lambda a, b: F.avg(F.when(F.col("_found") == 1, F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")))
    return both.agg(F.count("*").alias("rows"), F.count("_found").alias("found"), same("category", "_category").alias("category_rate"), same("target", "_target").alias("target_rate"))
