"""Ranking candidates inside groups, and the metrics of rankings.

Input rows are candidates with a group (``target_id``), an id (``record_id``), a ``score``, a relevance (``rel``) and a 0/1
``success``. More keys (method, seed, group) may precede the target, so that all methods are evaluated in one job. Scores that
are null or not a number come last; ties go to the smaller record id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions.columns import ranked_score

from .shared import numbers_first


def by_group(keys: Sequence[str], key: str, descending: bool = True, tie: str = "record_id") -> Window:
    value = ranked_score(F.col(key))
    return Window.partitionBy(*keys).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), tie)


def rank_candidates(df: DataFrame, keys: Sequence[str] = ("target_id",), score: str = "score", descending: bool = True, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by_group(keys, score, descending)))


def top_k(df: DataFrame, k: int, keys: Sequence[str] = ("target_id",), score: str = "score", descending: bool = True) -> DataFrame:
    """The best ``k`` of each group; Spark limits each group before the shuffle."""
    return rank_candidates(df, keys, score, descending).where(F.col("rn") <= k)


def choice(score: str, *fields: str) -> Column:
    """A struct whose smallest in a group is that of the row of rank 1: by score, then by the first of ``fields``."""
    value = ranked_score(F.col(score))
    return F.struct(value.isNull().alias("_none"), (-value).alias("_value"), *fields)


def success_at(k: int) -> Column:
    return F.max(F.when((F.col("rn") <= k) & (F.col("success") == 1), 1).otherwise(0))


def _gain(rel: Column) -> Column:
    """What is null, not a number or negative gains nothing."""
    return F.greatest(F.coalesce(ranked_score(rel), F.lit(0.0)), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    """Needs ``rn`` by score and ``ideal_rn`` by relevance over all candidates of the group; 0 where the ideal is 0."""
    got = F.sum(F.when(F.col("rn") <= k, _gain(F.col("rel")) / F.log2(F.col("rn") + 1.0)).otherwise(0.0))
    best = F.sum(F.when(F.col("ideal_rn") <= k, _gain(F.col("rel")) / F.log2(F.col("ideal_rn") + 1.0)).otherwise(0.0))
    return F.when(best > 0, got / best).otherwise(0.0)


def regret_at(k: int) -> Column:
    """(best - best in the first k) / (best - worst); 0 for groups with one value. What is null or not a number counts as 0."""
    rel = F.coalesce(ranked_score(F.col("rel")), F.lit(0.0))
    best, worst, got = F.max(rel), F.min(rel), F.max(F.when(F.col("rn") <= k, rel))
    return F.when(best > worst, (best - got) / (best - worst)).otherwise(0.0)


def target_metrics(df: DataFrame, keys: Sequence[str] = ("target_id",), ks: Sequence[int] = (1, 3, 5), depth: int = 10) -> DataFrame:
    """One row per group: ``success_at_<k>``, ``ndcg<depth>``, ``regret<depth>``, ``top1`` and ``n``, in one shuffle."""
    by = numbers_first(df, keys)
    ranked = rank_candidates(rank_candidates(df, by), by, "rel", name="ideal_rn")
    per = ranked.groupBy(*by).agg(
        *[success_at(k).alias(f"success_at_{k}") for k in ks],
        ndcg_at(depth).alias(f"ndcg{depth}"),
        regret_at(depth).alias(f"regret{depth}"),
        F.max(F.when(F.col("rn") == 1, F.col("record_id"))).alias("top1"),
        F.count("*").alias("n"),
    )
    return per.select(*keys, *per.columns[len(by) :])


def on_front(keys: Sequence[str] = ("target_id",), up: str = "on", down: str = "off") -> Column:
    """Whether no other row of the group dominates a row (more of ``up``, less of ``down``, one strictly): no row with at most its ``down``
    has more ``up``, and none with its ``up`` has less ``down``. Rows in which either is null or not a number are not on it and dominate none."""
    known = F.col(up).isNotNull() & ~F.isnan(up) & F.col(down).isNotNull() & ~F.isnan(down)
    best = F.max(F.when(known, F.col(up))).over(Window.partitionBy(*keys).orderBy(F.when(known, F.col(down)).asc_nulls_first()))
    least = F.min(F.when(known, F.col(down))).over(Window.partitionBy(*keys, up))
    return known & (best == F.col(up)) & (least == F.col(down))


def pareto_front(df: DataFrame, keys: Sequence[str] = ("target_id",), up: str = "on", down: str = "off") -> DataFrame:
    """Rows that no other row of the group dominates; equal rows all stay, rows in which either is null or not a number are
    dropped. Sweeps over the sorted rows of a group (:func:`on_front`) replace the pairwise comparison, in one shuffle."""
    return df.withColumn("_front", on_front(keys, up, down)).where("_front").drop("_front")


def top1_agreement(df: DataFrame, one: str, other: str) -> DataFrame:
    """Share of targets for which two methods choose the same candidate; ``df`` has method."""
    pick = lambda m: F.min(F.when(F.col("method") == m, choice("score", "record_id")))["record_id"]
    return df.groupBy("target_id").agg(pick(one).alias("a"), pick(other).alias("b")).agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"), F.count("*").alias("n"))


def true_percentile(df: DataFrame) -> DataFrame:
    """Per target, the share of candidates whose relevance is below that of the method's first choice."""
    top = F.first("rel").over(by_group(("target_id",), "score"))
    return df.withColumn("_top", top).groupBy("target_id").agg(F.avg((F.col("rel") < F.col("_top")).cast("int")).alias("percentile"))


def relative_success(df: DataFrame, q: float = 0.8, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """``success`` as being at or above the group's own quantile of relevance (leaky; kept for comparison;
    the quantile is interpolated, so equality allows for rounding)."""
    cut = F.percentile("rel", F.lit(q)).over(Window.partitionBy(*keys))
    return df.withColumn("success", (F.col("rel") >= cut - 1e-9).cast("int"))


def candidate_budget(df: DataFrame, valid: str, ks: Sequence[int]) -> DataFrame:
    """Success where invalid and repeated entries still use up places: ranks come before validity."""
    turn = F.row_number().over(Window.partitionBy("target_id", "record_id").orderBy("rn"))
    ranked = rank_candidates(df).withColumn("_turn", turn)
    ok = F.col(valid) & (F.col("_turn") == 1) & (F.col("success") == 1)
    return ranked.groupBy("target_id").agg(*[F.max(F.when((F.col("rn") <= k) & ok, 1).otherwise(0)).alias(f"success_at_{k}") for k in ks], F.avg(F.col(valid).cast("int")).alias("valid_rate"))


def budget_costs(per_target: DataFrame, hit: str, k: int, context: str) -> DataFrame:
    """``hits, spent, cost_per_hit, context_gap``: entries spent (``k`` a target, or all it has), entries for each hit, and the
    difference of the hit rates of the best and the worst context. ``per_target`` has the hits, n and the context."""
    rates = per_target.groupBy(context).agg(F.avg(hit).alias("r")).agg((F.max("r") - F.min("r")).alias("context_gap"))
    whole = per_target.agg(F.sum(hit).cast("long").alias("hits"), F.sum(F.least(F.col("n"), F.lit(k))).cast("long").alias("spent"))
    return whole.withColumn("cost_per_hit", F.col("spent") / F.nullif(F.col("hits"), F.lit(0))).crossJoin(rates)  # one row each
