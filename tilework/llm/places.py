"""Places of rows inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def placed(df: DataFrame, group: str, order: Sequence[str], name: str = "placed") -> DataFrame:
    """``df`` with ``at`` (place in the group from 0, by ``order``, nulls first) and ``n`` (rows of the group).

    Rows are dealt by ranges of group and order and written; a row's place is its place in its range plus the rows of the
    group in the ranges before it, whose table has a row for each range and group. ``group`` must have no nulls. Rows that
    are equal in all of ``order`` keep any order among themselves.
    """
    dealt = common.written(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), name)
    sums = dealt.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(group, "_part", before.alias("_before"), F.sum("_rows").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    out = dealt.withColumn("_inside", inside).join(sums, [group, "_part"])
    return out.withColumn("at", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")
