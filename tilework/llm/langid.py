"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows. Weights are learnt by follow-the-regularised-leader with
elastic-net penalties on a bounded sample (``SAMPLE`` rows by hash) in shards that are averaged; a temperature is then
fitted on a tenth of the sample that took no part. Whole texts are read in pieces of a million characters.

Only text and the language of training rows are learnt from. A null text or one without a letter (a character of Unicode's category L) is ``und`` with score 1;
without any training row every text is ``und``; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linear import gram_counts, sampled, softmax, train

ORDERS, BITS, SAMPLE = (1, 2, 3), 15, 6000


def counts(text: str) -> np.ndarray:
    return gram_counts(np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4"), ORDERS, BITS)


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values: 1 + log of the count, times idf, scaled to length 1."""
    c = counts(text)
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    return at, x / max(1e-12, np.linalg.norm(x))


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """Smoothed idf of every hashed n-gram over all rows (column text); each task sends its sums."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df += counts(t.as_py()) > 0
                n += 1
        at = np.append(np.flatnonzero(df), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(df[at[:-1]], n))], ["feature", "n"])

    common.ship(rows.sparkSession)
    got = {r.feature: r.n for r in rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total, df = got.pop(-1, 0), np.zeros(1 << BITS)
    df[list(got)] = list(got.values())
    return np.log((1 + total) / (1 + df)) + 1


class Model:
    """Languages, weights, idf and temperature; what is broadcast to the tasks is bounded by the number of features."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray):
        self.langs, self.weights, self.idf, self.temperature = langs, weights, idf, 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = tfidf(text, self.idf)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 1.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``rows`` (id, text, lang; none null)."""
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    idf = inverse_frequencies(rows)
    some = common.written(sampled(rows, "id", sample, 17), "language-sample")
    target = F.array(*[(F.col("lang") == c).cast("double") for c in langs]) if langs else F.array().cast("array<double>")
    some = some.withColumn("target", target).withColumn("tenth", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(10)) == 0)
    if not langs:
        return Model(langs, np.zeros((1 << BITS, 0)), idf)
    model = Model(langs, train(some.where("not tenth"), lambda t: tfidf(t, idf), 1 << BITS, len(langs)), idf)

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.logits(t.as_py()).tolist() for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["logits", "target"])

    got = some.where("tenth").select("text", "target").mapInArrow(held, "logits array<double>, target array<double>").collect()
    if got:
        x, y = np.array([r.logits for r in got]), np.array([r.target for r in got])
        grid = np.geomspace(0.05, 20, 241)
        loss = [-np.log(np.maximum(1e-12, (softmax(x / t) * y).sum(1))).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""

    def run(batches):
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    common.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows in the held-out fold are not learnt from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.where((common.fold("id") != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return identify(docs, model, id_col, text_col).select("doc_id", F.coalesce(common.fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
