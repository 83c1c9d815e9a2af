"""Exact ranks and percentiles of whole tables by distributed selection.

Rows are counted by value first, so that repeated values cost one row. The counts are dealt by ranges of key and value; sums of
ranges give each range the number of rows before it, and running sums inside ranges give each value its ranks. No task holds a group:
only its own range, and a number for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def _tag(keys: Sequence[str]):
    """One string for a group's keys; null keys are groups of their own."""
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")


def value_places(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``_g, value, _n, _before, _total``: how many rows of a group have a value, come before it, and there are. ``_g`` names the group;
    see :func:`tagged`. Nulls are left out."""
    return places(df.where(F.col(value).isNotNull()).groupBy(_tag(keys).alias("_g"), value).agg(F.count("*").alias("_n")), value)


def tagged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_g``, one string for a group's keys."""
    return df.withColumn("_g", _tag(keys))


def places(counts: DataFrame, value: str) -> DataFrame:
    """``counts``, a row with its rows' number ``_n`` for each ``_g`` and value, with ``_before`` and ``_total`` of :func:`value_places`."""
    dealt = written(counts.repartitionByRange("_g", value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_g", "_part").agg(F.sum("_n").alias("_rows"))
    whole = Window.partitionBy("_g")  # a row a range
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_g", "_part", before.alias("_offset"), F.sum("_rows").over(whole).alias("_total"))
    inside = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy(value)) - F.col("_n")
    found = dealt.withColumn("_inside", inside).join(sums, ["_g", "_part"])
    return found.select(*counts.columns, (F.col("_offset") + F.col("_inside")).alias("_before"), "_total")


def from_middle() -> Column:
    """Distance of a value's mean rank from its group's middle rank, of places."""
    return F.col("_before") + (F.col("_n") + 1) / 2.0 - (F.col("_total") + 1) / 2.0


def percentiles(df: DataFrame, value: str, qs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Percentiles with linear interpolation, a column for each name in ``qs`` and a row for each group; without keys, and without
    values, one row (of nulls). NaN counts as the largest value."""
    at_value = value_places(df.withColumn("_v", F.col(value).cast("double")), "_v", keys)

    def at(rank):
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))

    ends, out = [], []
    for i, (name, q) in enumerate(qs.items()):
        spot = (F.col("_total") - 1) * F.lit(float(q))
        ends += [at(F.floor(spot)).alias(f"_lo{i}"), at(F.ceil(spot)).alias(f"_hi{i}"), F.max(spot - F.floor(spot)).alias(f"_part{i}")]
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(low == high, low).otherwise(low + (high - low) * F.col(f"_part{i}")).alias(name))
    found = at_value.groupBy("_g").agg(*ends) if keys else at_value.agg(*ends)
    if not keys:
        return found.select(*out)
    names = df.select(_tag(keys).alias("_g"), *keys).distinct()
    return names.join(found, "_g", "left").select(*keys, *out)
