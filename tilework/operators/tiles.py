"""Windows that tile a source: neighbours, overlaps, strides, representatives, overlap components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions.sequences import occurrences, overlap

from .quantiles import percentiles


def adjacent(df: DataFrame, sequence: str = "trigger") -> DataFrame:
    """Each window with the next of its target: ``next_tile, next_seq``."""
    w = Window.partitionBy("target_id").orderBy("tile", sequence)
    return df.withColumn("next_tile", F.lead("tile").over(w)).withColumn("next_seq", F.lead(sequence).over(w)).where("next_seq is not null")


def adjacent_identity(df: DataFrame, sequence: str = "trigger", length: int = 30) -> DataFrame:
    return adjacent(df, sequence).withColumn("identity", overlap(F.col(sequence), F.col("next_seq"), length) / F.lit(float(length)))


def identity_profile(df: DataFrame) -> DataFrame:
    i = F.col("identity")
    share = lambda x: F.avg((i >= x).cast("int"))
    shares = df.agg(F.count("*").alias("n"), F.avg(i).alias("mean"), F.min(i).alias("low"), F.max(i).alias("high"), share(0.5).alias("share50"), share(0.8).alias("share80"), share(1.0).alias("share100"))
    return shares.crossJoin(percentiles(df, "identity", {"median": 0.5})).select("n", "mean", "median", "low", "high", "share50", "share80", "share100")  # one row each


def tiling_step(df: DataFrame) -> DataFrame:
    """Smallest difference of neighbouring tiles of each target."""
    w = Window.partitionBy("target_id").orderBy("tile")
    return df.select("target_id", "tile").distinct().withColumn("d", F.lead("tile").over(w) - F.col("tile")).groupBy("target_id").agg(F.min("d").alias("step"))


def stride_modes(positions: DataFrame, top: int = 3, least: int = 100) -> DataFrame:
    """The most common differences of sorted positions of each source, for sources with enough positions."""
    many = positions.where("source is not null").withColumn("n", F.count("*").over(Window.partitionBy("source"))).where(F.col("n") >= least)
    d = many.withColumn("stride", F.lead("pos").over(Window.partitionBy("source").orderBy("pos")) - F.col("pos")).where("stride is not null")
    counts = d.groupBy("source", "stride").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "stride"))).where(F.col("rn") <= top)


def representative(df: DataFrame, sequence: str = "trigger") -> DataFrame:
    """The window with the middle G+C count of each source (place n // 2 of the sorted), ties by record id."""
    gc = occurrences(F.col(sequence), "G") + occurrences(F.col(sequence), "C")
    ranked = df.withColumn("gc", gc).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("gc", "record_id"))).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    return ranked.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).drop("rn", "n")


def overlap_components(df: DataFrame, key: str, kmers: str) -> DataFrame:
    """``key, component``: keys that share a k-mer, directly or through others; the component is its smallest key.

    ``df`` has one row per key and k-mer. Each k-mer links its keys to the smallest of them; see :func:`components`.
    """
    low = df.groupBy(kmers).agg(F.min(key).alias("v"))
    parts = components(df.join(low, kmers).select(F.col(key).alias("u"), "v"))
    return df.select(key).distinct().join(parts, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for each node of ``edges`` (u, v) that has another, the smallest node it is connected with.

    Every round links all neighbours of a node to the smallest of them, first upwards, then downwards; the number of rounds grows with the
    logarithm of the largest component. Rounds are checkpointed in the shared folder.
    """
    _shared_checkpoints(edges.sparkSession)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        up = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = down.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()


def _shared_checkpoints(spark) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; only on one machine may that be unset."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tilework-")
    context.setCheckpointDir(folder)
