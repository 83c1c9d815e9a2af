"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

Eight labellers vote good, bad or nothing on a text's style. The pattern of votes of every document is counted
in Spark (at most 3**8 patterns, however many documents), and expectation-maximisation on these counts estimates how often each
labeller votes what on good and on bad documents, and the share of good ones. No rate is bounded: labellers
overlap (symbols with marked words, repeated neighbours with variety, list marks with sentence ends), so that faults show as votes that agree. The posteriors of a bounded sample are the
soft targets of a linear model on hashed n-grams of character classes and binned style figures, which scores every text.

A null or empty text gets the votes of no words and a score like any other; repeated rows are scored alike; an empty table
gives no rows; no labels are read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linear import gram_counts, sampled, softmax, train

BITS, ORDERS, SAMPLE, BINS = 13, (2, 4), 6000, 16
#: Character classes: 0 other, 1 white space, 2 lower case, 3 upper case, 4 digit, 5 sentence end, 6 other punctuation, 7 symbol.
LABELLERS = ("symbols", "upper case", "repeated neighbours", "list marks", "marked words", "sentence ends", "variety", "size")


@lru_cache
def _classes() -> np.ndarray:
    """Class of every code point, from its Unicode category."""

    def of(c: str) -> int:
        if c in ".!?":
            return 5
        kind = unicodedata.category(c)
        if kind[0] == "Z" or c.isspace():
            return 1
        return {"Lu": 3, "Lt": 3, "Nd": 4}.get(kind, {"L": 2, "M": 2, "P": 6, "S": 7}.get(kind[0], 0)) if c not in "#$%&*@|~^_\\<>{}[]" else 7

    return np.fromiter((of(chr(c)) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def style(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Style figures of a text and the classes of its characters."""
    text = text or ""
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    n = np.bincount(kinds, minlength=8)
    words = text.lower().split()
    w = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    parts = [words[i : i + 100] for i in range(0, len(words), 100)]
    variety = np.mean([len(set(p)) / len(p) for p in parts]) if parts else 0.0
    ends = n[5] / w
    lists = sum(x in ("|", "-", "*", "•") for x in words) / w
    # Words that hold a symbol: by the number of each word.
    number = np.cumsum(np.append(True, kinds[:-1] == 1) & (kinds != 1)) if len(kinds) else kinds
    marked = len(np.unique(number[kinds == 7])) / w
    return np.array([n[7] / w, n[3] / max(1, n[2] + n[3]), again / w, lists, marked, ends, variety, len(words)]), kinds


def votes(figures: np.ndarray) -> np.ndarray:
    """Of each labeller 1 (good), -1 (bad) or 0 (no vote, between the two)."""
    f = figures
    bad = np.array([f[0] > 0.25, f[1] > 0.4, f[2] > 0.15, f[3] > 0.08, f[4] > 0.2, f[5] > 0.6 or f[5] < 0.004, f[6] < 0.35, f[7] < 5])
    good = np.array([f[0] < 0.05, f[1] < 0.2, f[2] < 0.05, f[3] < 0.02, f[4] < 0.05, 0.01 <= f[5] <= 0.3, f[6] > 0.5, f[7] >= 40])
    return np.where(bad, -1, good.astype(int))


def pattern(v: np.ndarray) -> int:
    return int(((v + 1) * 3 ** np.arange(len(v))).sum())


class LabelModel:
    """Two classes; each labeller's votes are independent given the class."""

    def __init__(self, counts: dict[int, int], rounds: int = 200):
        keys = np.array(sorted(counts))
        weight = np.array([counts[k] for k in keys.tolist()], float)
        m = len(LABELLERS)
        v = keys[:, None] // 3 ** np.arange(m) % 3  # 0 bad, 1 none, 2 good
        good = np.where((v == 0).any(1), 0.1, 0.9)  # to begin with, one fault is enough
        for _ in range(rounds):
            post = np.stack([1 - good, good], 1) * weight[:, None]
            share = (post.sum(0) + 1) / (post.sum() + 2)
            rate = np.stack([[(post * (v[:, j] == k)[:, None]).sum(0) for k in range(3)] for j in range(m)]) + 0.5
            rate /= rate.sum(1, keepdims=True)
            log = np.log(share)[None] + sum(np.log(rate[j][v[:, j]]) for j in range(m))
            new = softmax(log)[:, 1]
            if np.abs(new - good).max() < 1e-9:
                break
            good = new
        self.share, self.rate = share, rate

    def good(self, v: np.ndarray) -> float:
        log = np.log(self.share) + sum(np.log(self.rate[j][int(x) + 1]) for j, x in enumerate(v))
        return float(softmax(log[None])[0, 1])

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each labeller: how often its votes on bad and on good documents are right."""
        return {name: (r[0, 0] / (r[0, 0] + r[2, 0]), r[2, 1] / (r[0, 1] + r[2, 1])) for name, r in zip(LABELLERS, self.rate, strict=True)}


def featurize(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of character classes (log counts, scaled) and one bin for each style figure."""
    return _features(*style(text))


def _features(figures: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = gram_counts(kinds, ORDERS, BITS)
    at = np.flatnonzero(c)
    x = np.log1p(c[at])
    x /= max(1e-12, np.linalg.norm(x))
    scale = np.array([8, 15, 20, 40, 15, 20, 15, 0])
    bins = np.minimum(np.append((figures * scale)[:7], np.log2(figures[7] + 1)).astype(int), BINS - 1)
    return np.append(at, (1 << BITS) + np.arange(8) * BINS + bins), np.append(x, np.full(8, 0.5))


def quality(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, weak_label, kept``: the scorer's and the label model's chance that a text is good."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        n: dict[int, int] = {}
        for b in batches:
            for t in b.column(0):
                k = pattern(votes(style(t.as_py())[0]))
                n[k] = n.get(k, 0) + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["pattern", "n"])

    counts = {r.pattern: r.n for r in rows.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "doc_id long, score double, weak_label double, kept boolean")
    labels = LabelModel(counts)

    def soft(batches):
        for b in batches:
            good = [labels.good(votes(style(t.as_py())[0])) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[1 - g, g] for g in good], pa.list_(pa.float64()))], ["id", "text", "target"])

    some = common.written(sampled(rows, "id", sample, 31).mapInArrow(soft, "id long, text string, target array<double>"), "quality-sample")
    w = train(some, featurize, (1 << BITS) + 8 * BINS, 2)

    def score(batches):
        for b in batches:
            got = []
            for t in b.column(1):
                figures, kinds = style(t.as_py())
                at, x = _features(figures, kinds)
                got.append((float(softmax(x @ w[at])[1]), labels.good(votes(figures))))
            s, l = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(l, pa.float64())], ["doc_id", "score", "weak_label"])

    return rows.mapInArrow(score, "doc_id long, score double, weak_label double").withColumn("kept", F.col("score") >= threshold)
