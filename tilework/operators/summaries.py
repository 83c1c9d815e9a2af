"""Dataset summaries: maps, ledgers, profiles, histograms and label accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def source_map(df: DataFrame) -> DataFrame:
    """Per target: category, rows, paired rows, characterised rows, first and last tile."""
    return df.groupBy("target_id").agg(F.min("category").alias("category"), F.count("*").alias("n"), F.count_if(F.col("status") == "admitted_paired").alias("n_paired"), F.sum(F.col("characterized").cast("int")).alias("n_characterized"), F.min("tile").alias("tile_min"), F.max("tile").alias("tile_max"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, paired rows and distinct targets, by category and over all (null category)."""
    return df.groupingSets([["category"], []], "category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "admitted_paired").alias("n_paired"), F.countDistinct("target_id").alias("targets"))


def group_sizes(df: DataFrame, key: str = "target_id") -> DataFrame:
    n = F.col("n")
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    ends = sizes.agg(F.count("*").alias("groups"), F.min(n).alias("low"), F.avg(n).alias("mean"), F.max(n).alias("high"), F.count_if(n >= 100).alias("n_100"), F.count_if(n >= 10).alias("n_10"))
    return ends.crossJoin(percentiles(sizes, "n", {"median": 0.5, "p95": 0.95})).select("groups", "low", "median", "mean", "p95", "high", "n_100", "n_10")  # one row each


def reject_reason(source, identifier, tile) -> F.Column:
    """Why a raw row is not admitted; null for admitted rows."""
    return F.when(F.coalesce(source, F.lit("")) == "", "missing_source").when(F.coalesce(identifier, F.lit("")) == "", "missing_id").when(tile.isNull(), "bad_tile")


def ledger(rejected: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Counts by reason, and a row for what lacks a label."""
    return rejected.groupBy("reason").agg(F.count("*").alias("n")).unionByName(unlabelled.agg(F.lit("label_missing").alias("reason"), F.count("*").alias("n")))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def quantile_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), qs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """One row per key and column with its quantiles."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.name", "x.v")
    return percentiles(long, "v", {f"p{round(q * 100)}": q for q in qs}, (*keys, "name"))


def threshold_shares(df: DataFrame, column: str, cuts: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg((F.col(column) >= c).cast("int")).alias(f"ge_{i}") for i, c in enumerate(cuts)])


def label_states(df: DataFrame, on: str = "on", off: str = "off") -> DataFrame:
    state = F.when(F.col(on).isNotNull() & F.col(off).isNotNull(), "both").when(F.col(on).isNotNull(), "on_only").when(F.col(off).isNotNull(), "off_only").otherwise("none")
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def by_group_and_all(df: DataFrame, keys: Sequence[str], group: str, *aggregates) -> DataFrame:
    """Aggregates for each group and for all groups together (group ``all``)."""
    out = df.groupingSets([[*keys, group], [*keys]], *keys, group).agg(*aggregates, F.grouping(group).alias("_all"))
    return out.withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all")


def success_profile(df: DataFrame) -> DataFrame:
    """Pooled success rate, mean and median of per-target rates, and targets with a success."""
    per = df.groupBy("target_id").agg(F.sum("success").alias("s"), F.count("*").alias("n"))
    per = per.withColumn("r", F.col("s") / F.col("n"))
    rates = per.agg((F.sum("s") / F.sum("n")).alias("pooled"), F.avg("r").alias("mean_rate"), F.count_if(F.col("s") > 0).alias("targets_with_success"), F.count("*").alias("targets"))
    return rates.crossJoin(percentiles(per, "r", {"median_rate": 0.5})).select("pooled", "mean_rate", "median_rate", "targets_with_success", "targets")  # one row each


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from the least to the largest value (which falls in the last bin)."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # ends is one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return placed.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def label_consistency(df: DataFrame, on: str = "on", off: str = "off", rel: str = "rel") -> DataFrame:
    """Share of rows where the sign of the difference is the sign of ``rel``; missing values disagree."""
    same = F.coalesce(F.signum(F.col(on) - F.col(off)) == F.signum(F.col(rel)), F.lit(False))
    return df.agg(F.avg(same.cast("int")).alias("sign_agreement"), F.count("*").alias("n"))


def value_spread(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg((v < 0).cast("int")).alias("share_negative"), F.avg((v > 0).cast("int")).alias("share_positive"), F.count(v).alias("n"))


def attribution_summary(df: DataFrame) -> DataFrame:
    """Rows and distinct targets by split, category and match kind, with totals by split."""
    return df.groupingSets([["split", "category", "match"], ["split"]], "split", "category", "match").agg(F.count("*").alias("n"), F.countDistinct("target_id").alias("targets"))


def triple_match(one: DataFrame, other: DataFrame, digits: int = 4) -> DataFrame:
    """Rows of two sources whose three label values agree after rounding."""
    key = lambda d: d.select("record_id", *[F.round(c, digits).alias(c) for c in ("on", "off", "rel")])
    return key(one).join(key(other).withColumnRenamed("record_id", "other_id"), ["on", "off", "rel"])
