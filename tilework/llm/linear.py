"""Hashed linear models: bounded samples, character n-gram features and follow-the-regularised-leader in shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 8


def sampled(rows: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` of the rows (all, if fewer), chosen by two hashes of their key: millionths and shares of one, fine enough for any table."""
    n = rows.count()
    part = min(1.0, bound / max(n, 1))
    whole, rest = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)), F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(2**31))
    return rows.where((whole + rest / 2.0**31) / 1e6 < part) if part < 1 else rows


def gram_ids(codes: np.ndarray, orders, bits: int) -> np.ndarray:
    """Hashed ids of all n-grams of a code array."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    out = []
    for n in orders:
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out.append(((h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gram_counts(codes: np.ndarray, orders, bits: int, piece: int = 1_000_000) -> np.ndarray:
    """Counts of all n-grams of a text of any length, piece by piece."""
    if len(codes) <= piece:
        return np.bincount(gram_ids(codes, orders, bits), minlength=1 << bits)
    total = np.zeros(1 << bits, np.int64)
    for n in orders:
        for lo in range(0, len(codes), piece):
            total += np.bincount(gram_ids(codes[lo : lo + piece + n - 1], (n,), bits), minlength=1 << bits)
    return total


class Ftrl:
    """Follow-the-regularised-leader (proximal) for softmax regression with elastic-net penalties and soft targets."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        w = self.weights(at)
        g = x[:, None] * (softmax(x @ w) - target)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(sample: DataFrame, featurize, features: int, classes: int, epochs: int = 3) -> np.ndarray:
    """Weights (feature, class) learnt in shards of a bounded sample (``id, text, target``) and averaged.

    ``featurize`` gives a text's feature ids and values. At most ``features * classes`` numbers reach the driver.
    """

    def shard(table):
        rows = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), table.column("target").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
        made = [(*featurize(t), np.array(y)) for _, t, y in rows]
        model, rng = Ftrl(features, classes), np.random.default_rng(0)
        for _ in range(epochs):
            for k in rng.permutation(len(made)):
                model.learn(*made[k])
        w = model.weights()
        f, c = np.nonzero(w)
        return pa.table({"feature": pa.array(f, pa.int64()), "class": pa.array(c, pa.int64()), "weight": pa.array(w[f, c], pa.float64())})

    common.ship(sample.sparkSession)
    split = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SHARDS)))
    shards = max(1, split.select("shard").distinct().count())
    learnt = split.groupBy("shard").applyInArrow(shard, "feature long, class long, weight double").groupBy("feature", "class").agg(F.sum("weight").alias("weight")).collect()
    w = np.zeros((features, classes))
    for r in learnt:
        w[r["feature"], r["class"]] = r["weight"] / shards
    return w
