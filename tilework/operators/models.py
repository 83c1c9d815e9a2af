"""Score producers: built-in scorers, regressors on sequence features, seed averages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions.columns import fallback_score, gc_fraction, unit_hash
from tilework.functions.sequences import composition, one_hot

from .shared import written


def builtin_scores(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """``score`` by a named scorer: random, gc or thermo."""
    scorers = {
        "random": lambda: unit_hash(seed, F.col("record_id")),
        "gc": lambda: gc_fraction(F.col("trigger"), None),
        "thermo": lambda: fallback_score(F.col("salis"), F.col("mfe_off")),
    }
    if name not in scorers:
        raise ValueError(f"no scorer {name!r}; there are {sorted(scorers)}")
    return df.withColumn("score", scorers[name]())


def submitted_scores(df: DataFrame, submission: DataFrame) -> DataFrame:
    """Scores of a submission; rows without one get 0, and the largest of several for one record counts."""
    one = submission.groupBy("record_id").agg(F.max("score").alias("score"))
    return df.join(one, "record_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def seed_average(scores: DataFrame) -> DataFrame:
    """Mean score of each record over seeds; ``scores`` has method, seed, record_id, score."""
    return scores.groupBy("method", "record_id").agg(F.avg("score").alias("score"))


def constant_mean(df: DataFrame, y: str) -> DataFrame:
    """The training mean as prediction for every row."""
    return df.crossJoin(F.broadcast(df.where("split = 'train'").agg(F.avg(y).alias("prediction"))))  # one row


def composition_regressor(df: DataFrame, sequence: str, y: str, trees: int = 20, depth: int = 4, seed: int = 0) -> DataFrame:
    """Boosted trees on the nine composition numbers, fitted on train rows; predictions for all rows. Features are made once:
    training reads rows several times. The sequences themselves are not kept."""
    numbers = composition(F.col(sequence)).cast("array<double>").alias("_numbers")
    rows = written(df.select(*[c for c in df.columns if c != sequence], numbers), "features")
    rows = rows.withColumn("features", array_to_vector("_numbers")).drop("_numbers")
    model = GBTRegressor(featuresCol="features", labelCol=y, maxIter=trees, maxDepth=depth, seed=seed).fit(rows.where("split = 'train'"))
    return model.transform(rows)


def sequence_model(train: DataFrame, sequence: str, y: str, extra: Sequence[str] = (), lenient: bool = False, length: int = 30) -> Callable[[DataFrame], DataFrame]:
    """Linear regression on one-hot letters, with further numeric columns if named: a function that adds ``prediction``."""
    letters = array_to_vector(one_hot(F.col(sequence), length, lenient).cast("array<double>"))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["_letters", *extra], outputCol="features"), LinearRegression(featuresCol="features", labelCol=y, regParam=0.01)])
    model = pipeline.fit(train.withColumn("_letters", letters))
    return lambda df: model.transform(df.withColumn("_letters", letters)).drop("_letters", "features")


def sequence_regressor(df: DataFrame, sequence: str, y: str, extra: Sequence[str] = (), lenient: bool = False, length: int = 30) -> DataFrame:
    """:func:`sequence_model` fitted on train rows; predictions for all rows. The rows are made once: a sequence that is computed
    would be computed again for each of its letters."""
    df = written(df, "sequences")
    return sequence_model(df.where("split = 'train'"), sequence, y, extra, lenient, length)(df)
