"""The leaderboard: admitted candidates, scores of built-in methods and submissions, metrics with intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions.columns import ranked_score

from . import models, ranking, resampling


def evaluable(df: DataFrame) -> DataFrame:
    """Rows with both labels and a relevance."""
    return df.where((F.col("status") == "admitted_paired") & ranked_score(F.col("rel")).isNotNull())


def all_scores(df: DataFrame, builtin: Sequence[str], submissions: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``df`` once for every method, with ``method`` and ``score``: the built-in scorers, and the methods of ``submissions``
    (method, record_id, score), whose missing scores are 0 and of whose repeated ones the largest counts."""
    out = None
    for name in builtin:
        one = models.builtin_scores(df, name, seed).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if submissions is None:
        return out
    names = F.broadcast(submissions.select("method").distinct())  # a row a submission
    scores = submissions.groupBy("method", "record_id").agg(F.max("score").alias("score"))
    rows = df.crossJoin(names).join(scores, ["method", "record_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows if out is None else out.unionByName(rows)


def per_target(scored: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return ranking.target_metrics(scored, ("method", "target_id"), ks)


def leaderboard(metrics: DataFrame, ks: Sequence[int] = (1, 3, 5), replicates: int = 2000, digits: int = 4) -> DataFrame:
    """Mean and interval of every metric of each method, rounded; all methods and metrics share the draws."""
    names = [*[f"success_at_{k}" for k in ks], "ndcg10", "regret10"]
    out = resampling.bootstrap_means(metrics, names, "target_id", ("method",), replicates)
    return out.select("method", *[F.round(f"{c}_{x}", digits).alias(f"{c}_{x}") for c in names for x in ("mean", "lo", "hi")], "n")


def over_seeds(scored: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Per-target metrics of each method as means over its seeds; ``scored`` has method and seed."""
    runs = ranking.target_metrics(scored, ("method", "seed", "target_id"), ks)
    names = [*[f"success_at_{k}" for k in ks], "ndcg10", "regret10"]
    return runs.groupBy("method", "target_id").agg(*[F.avg(c).alias(c) for c in names])
