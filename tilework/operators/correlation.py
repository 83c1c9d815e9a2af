"""Rank correlation, per group and pooled, and regression errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions.columns import finite

from .quantiles import from_middle, places, tagged
from .shared import numbers_first, written


def average_rank(keys: Sequence[str], value: str) -> Column:
    """Rank within a group, ties sharing their mean rank: the mean of the first and the last of their places, both in one sweep."""
    places = Window.partitionBy(*keys).orderBy(value)
    return (F.rank().over(places) + F.count("*").over(places.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; null where either side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def pearson(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.where(finite(F.col(a)) & finite(F.col(b))).groupBy(*keys).agg(safe_corr(a, b).alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, keys: Sequence[str], a: str = "score", b: str = "rel", least: int = 3) -> DataFrame:
    """``rho, n`` per group over finite pairs; groups of fewer rows or with one label value are left out, and rho is null
    where the other side is constant."""
    by = numbers_first(df, keys)
    rows = df.where(finite(F.col(a)) & finite(F.col(b))).withColumn("_ra", average_rank(by, a)).withColumn("_rb", average_rank(by, b))
    out = rows.groupBy(*by).agg(safe_corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"), F.stddev_pop(b).alias("_s"))
    return out.where((F.col("n") >= least) & (F.col("_s") > 0)).select(*keys, "rho", "n")


def spearman_beside(df: DataFrame, keys: Sequence[str], *more: Column, a: str = "score", b: str = "rel", least: int = 3) -> DataFrame:
    """``rho, n`` of :func:`spearman` for every group, null where that leaves a group out, beside other aggregates over all rows of the group, in the same sorts."""
    by, ok = numbers_first(df, keys), finite(F.col(a)) & finite(F.col(b))
    rows = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("_ra", F.when(F.col("_ok"), average_rank([*by, "_ok"], a))).withColumn("_rb", F.when(F.col("_ok"), average_rank([*by, "_ok"], b)))
    out = rows.groupBy(*by).agg(safe_corr("_ra", "_rb").alias("rho"), F.count("_ra").alias("_n"), F.stddev_pop(F.when(F.col("_ok"), F.col(b))).alias("_s"), *more)
    kept = (F.col("_n") >= least) & (F.col("_s") > 0)
    return out.select(*keys, F.when(kept, F.col("rho")).alias("rho"), F.when(kept, F.col("_n")).alias("n"), *out.columns[len(by) + 3 :])


def pooled_spearman(df: DataFrame, a: str = "score", b: str = "rel", keys: Sequence[str] = ()) -> DataFrame:
    """``rho, n`` over all finite rows of each group of ``keys``; rho is null where a side is constant.

    Ranks come from range partitions (:mod:`quantiles`), as distances from their middle. Rows meet the ranks of ``b``, which should have
    the fewer values, and are summed by ``a``: the sum of products is that of each rank of ``a`` times its rows' ranks of ``b``, so rows
    need no ranks of ``a``, and a value that many rows share is one row.
    """
    rows = written(df.where(finite(F.col(a)) & finite(F.col(b))).select(*keys, a, b), "pairs")
    counts = tagged(rows.groupBy(*keys, b).agg(F.count("*").alias("_n")), keys)
    ranks = written(places(counts, b).select("_g", *keys, b, from_middle().alias("_rb"), "_n"), "ranks")
    other = ranks.select("_g", F.col(b).alias("_b"), "_rb", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = rows.join(other, [F.col(b) == F.col("_b"), *same])
    x, y, w = from_middle(), F.col("_rb"), F.col("_n")
    mine = places(met.groupBy("_g", a).agg(F.count("*").alias("_n"), F.sum("_rb").alias("_sum")), a)
    mine = mine.groupBy("_g").agg(F.sum(x * F.col("_sum")).alias("_xy"), F.sum(w * x * x).alias("_xx"))
    sums = ranks.groupBy("_g", *keys).agg(F.sum(w * y * y).alias("_yy"), F.sum(w).alias("n")).join(mine, "_g")
    if not keys:  # one row, also without rows
        sums = sums.agg(*[F.max(c).alias(c) for c in ("_xy", "_xx", "_yy")], F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return sums.select(*keys, (F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("_yy")), F.lit(0.0))).alias("rho"), "n")


def regression_errors(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "prediction") -> DataFrame:
    """``r2, mae, n``; r2 is null for a constant y."""
    total = F.var_pop(y) * F.count("*")
    return df.groupBy(*keys).agg((1 - F.sum((F.col(y) - F.col(p)) ** 2) / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.count("*").alias("n"))
