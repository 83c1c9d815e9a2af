"""Splits that keep groups apart, leaky controls, gates and leak measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions.columns import hash_digits, unit_hash

from .shared import written


def _placed(df: DataFrame, key: str, train: float, val: float, seed: int) -> DataFrame:
    """The distinct keys with ``_h``, their place in hash order, and the places of the last keys of train and of val.

    The order is taken within 256 hash ranges whose counts give the offsets, so no task sorts all keys.
    """
    keys = df.select(key).distinct().withColumn("_h", hash_digits(seed, F.col(key))).withColumn("_part", F.left("_h", F.lit(2)))
    keys = written(keys, "keys")  # counted and ranked
    counts = keys.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    ranked = keys.join(F.broadcast(counts), "_part").withColumn("_place", place)  # at most 256 rows are sent
    first = F.floor(F.col("_all") * train)
    return ranked.withColumn("_first", first).withColumn("_second", first + F.floor(F.col("_all") * val))


def group_disjoint(df: DataFrame, key: str = "target_id", train: float = 0.7, val: float = 0.15, seed: int = 0) -> DataFrame:
    """``key, split``: the distinct keys in hash order, cut exactly at the given shares."""
    ranked = _placed(df, key, train, val, seed)
    return ranked.select(key, F.when(F.col("_place") <= F.col("_first"), "train").when(F.col("_place") <= F.col("_second"), "val").otherwise("test").alias("split"))


def with_split(df: DataFrame, key: str = "target_id", train: float = 0.7, val: float = 0.15, seed: int = 0) -> DataFrame:
    """``df`` with the ``split`` of :func:`group_disjoint`, without rows whose key is null: a row's hash is compared with those of the last
    keys of train and of val, so rows are neither joined with keys nor shuffled. ``df`` is read twice: it should be a scan of a table."""
    last = {}
    ends = _placed(df, key, train, val, seed).where("_place in (_first, _second)").select("_h", key, "_place", "_first", "_second")
    for h, k, place, first, second in ends.collect():  # two rows at most
        last.update({name: (h, k) for name, end in (("train", first), ("val", second)) if place == end})
    split, kind = F.lit("test"), df.schema[key].dataType
    for name in ("val", "train"):
        if name in last:
            h, k = last[name]  # nulls sort first, so a last key that is null has no other key of its hash before it
            within = (F.col("_h") < h) | ((F.col("_h") == h) & F.coalesce(F.col(key) <= F.lit(k).cast(kind), F.lit(False)))
            split = F.when(within, name).otherwise(split)
    return df.where(F.col(key).isNotNull()).withColumn("_h", hash_digits(seed, F.col(key))).select(*df.columns, split.alias("split"))


def row_random(df: DataFrame, key: str = "record_id", train: float = 0.7, seed: int = 0) -> DataFrame:
    """Rows to train or test by a hash threshold (leaky control)."""
    return df.withColumn("split", F.when(unit_hash(seed, F.col(key)) < train, "train").otherwise("test"))


def manifest(df: DataFrame, key: str = "target_id") -> DataFrame:
    """Targets and records of each split."""
    return df.groupBy("split").agg(F.countDistinct(key).alias("targets"), F.count("*").alias("records"))


def pair_overlaps(df: DataFrame, key: str = "target_id") -> DataFrame:
    """For each pair of splits, how many keys are in both."""
    of = df.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("_s"))
    pairs = F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: b > a), lambda b: F.concat_ws("-", a, b))))
    return of.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def assert_disjoint(df: DataFrame, key: str = "target_id") -> DataFrame:
    """Fail if a key is in more than one split; else return ``df``."""
    n = df.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count()
    if n:
        raise ValueError(f"some {key} is in more than one split")
    return df


def leak_fraction(df: DataFrame, key: str = "target_id") -> DataFrame:
    """Share of test rows whose key is also in train; ``df`` has split_type and split."""
    seen = df.where("split = 'train'").select("split_type", key).distinct().withColumn("_seen", F.lit(1))
    test = df.where("split = 'test'").join(seen, ["split_type", key], "left")
    return test.groupBy("split_type").agg(F.avg(F.coalesce("_seen", F.lit(0))).alias("leak"), F.count("*").alias("n"))


def neighbour_leak(df: DataFrame, trials: int = 5, test: float = 0.2, seed: int = 0) -> DataFrame:
    """Per trial, the share of test windows with a neighbour (tile +-1 of the same target) in train."""
    t = df.select("target_id", "tile", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    t = t.withColumn("is_test", unit_hash(seed, F.col("trial"), F.col("target_id"), F.col("tile")) < test)
    near = t.where("not is_test").select("trial", "target_id", F.explode(F.array(F.col("tile") - 1, F.col("tile") + 1)).alias("tile")).distinct().withColumn("_near", F.lit(1))
    return t.where("is_test").join(near, ["trial", "target_id", "tile"], "left").groupBy("trial").agg(F.avg(F.coalesce("_near", F.lit(0))).alias("leak"), F.count("*").alias("n"))


def sequence_leak(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Sequences that occur in more than one split, by number of splits."""
    return df.groupBy(F.md5(F.col(sequence).cast("binary")).alias("h")).agg(F.countDistinct("split").alias("splits"), F.count("*").alias("rows")).groupBy("splits").agg(F.count("*").alias("sequences"), F.sum("rows").alias("rows"))


def held_out_group(df: DataFrame, group: str, held) -> DataFrame:
    """Hold out whole groups or contexts: rows of the ``held`` values are test."""
    return df.withColumn("split", F.when(F.col(group).isin(*held), "test").otherwise("train"))
