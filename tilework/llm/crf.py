"""Toxic spans by a linear-chain conditional random field over words.

Token labels come from document labels: features (a word, or its first 3 to 7 letters) that are far commoner in the toxic than in the
other documents of a bounded sample mark the tokens of toxic documents. A two-state chain over the words of a sentence is then
trained on those labels: emissions add the weights of a word's features, transitions are learnt, gradients come from the
forward-backward algorithm. Shards of the sample train apart and are averaged.

Scoring reads whole texts. Sentences in which no word has a positive weight have the background's marginals; the others run
forward-backward, and runs of words with marginals of a half or more are spans. A document's score is the chance that any of
its words of positive weight is toxic, by their marginals under the prior of documents.

A null or empty text has score 0 and no spans; repeated rows are scored alike; rows without a label are scored but not learnt
from; a row whose labels contradict each other counts as toxic; without toxic training rows all scores are those of the background;
an empty table gives no rows. Words are lower-cased one by one, so that spans are offsets in the text as it is.

Bounds of the training: ``SAMPLE`` labelled rows, ``CALIBRATION`` of them for the prior, ``VOCABULARY`` features, ``PER_SHARD`` sentences of each
kind in each of ``SHARDS`` shards (one in ``PLAIN`` of those without a word of the vocabulary), in parts of ``LONGEST`` words. Scoring has none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linear import sampled

WORD, SENTENCE = re.compile(r"[^\W_]+"), re.compile(r"[.!?\n]+")
STEMS = range(3, 8)
SAMPLE, STEPS, LONGEST, PER_SHARD, SHARDS, PLAIN, VOCABULARY, CALIBRATION = 20_000, 40, 32, 1500, 8, 20, 20_000, 4000
#: Tokens of one feature that count in one text, and the likelihood ratios from which a feature marks: one in a million by chance, and one in a few thousand.
MOST_A_TEXT, SURE, LIKELY = 5, 30.0, 12.0
#: Toxic documents of a shard at least, and such documents that a prior of its own sample takes.
A_SHARD, LEAST_APART = 250, 20


def words_of(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text))}


def features(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in STEMS if len(word) >= n)]


def _likelihood_ratio(bad: float, good: float, bad_all: float, good_all: float) -> float:
    """Dunning's statistic of a feature's tokens in toxic and in other documents; 0 unless it is commoner in the toxic ones."""
    share = (bad + good) / (bad_all + good_all)
    if bad * good_all <= good * bad_all:
        return 0.0
    return 2 * (bad * math.log(bad / (share * bad_all)) + (good * math.log(good / (share * good_all)) if good else 0.0))


def marked_features(sample: DataFrame) -> list[str]:
    """Features that mark toxic tokens; ``sample`` has text and toxic. Counts run over the whole sample in Spark.

    Tokens count, ``MOST_A_TEXT`` of a text at most, so that short words of one language stand out among all texts and a text that repeats
    itself does not. A feature marks if it is far commoner in toxic texts (by likelihood ratio and by rate). A toxic text
    without any mark, as in a language that few texts have, then takes its best feature among those that it shares with others.
    """

    def emit(wanted):
        def run(batches):
            for b in batches:
                texts, tokens = Counter(), Counter()
                for t in b.column(0):
                    own = Counter(f for w in WORD.findall(t.as_py()) for f in features(w.lower()) if wanted is None or f in wanted)
                    texts.update(own.keys())
                    tokens.update({f: min(n, MOST_A_TEXT) for f, n in own.items()})
                if texts:
                    names = list(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([texts[f] for f in names], pa.int64()), pa.array([tokens[f] for f in names], pa.int64())], ["feature", "texts", "tokens"])

        return run

    size = {r.toxic: (r.n, r.words) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("words")).collect()}
    (bad, bad_words), (_, good_words) = size.get(1, (0, 0)), size.get(0, (0, 0))
    if not bad:
        return []
    bad_words, good_words = max(bad_words, 1), max(good_words, 1)
    count = lambda toxic, wanted, least: {r.feature: (r.texts, r.tokens) for r in sample.where(F.col("toxic") == toxic).select("text").mapInArrow(emit(wanted), "feature string, texts long, tokens long").groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).where(F.col("texts") >= least).collect()}
    often = count(1, None, max(2, bad // 200))  # at most 200 times the features of a text
    also = count(0, frozenset(often), 1)
    strength, marks = {}, set()
    for f, (texts, tokens) in often.items():
        other = also.get(f, (0, 0))[1]
        g, rate = _likelihood_ratio(tokens, other, bad_words, good_words), other * bad_words / (tokens * good_words)
        if texts >= 3 and g >= SURE and rate <= 0.04:
            marks.add(f)
        elif g >= LIKELY and rate <= 0.1:
            strength[f] = g
    # A small table may have no feature that is sure: then those that several toxic texts have and no other.
    marks = marks or {f for f, (texts, _) in often.items() if texts >= 3 and f not in also}

    def best(batches):
        for b in batches:
            found = []
            for t in b.column(0):
                own = {f for w in words_of(t.as_py()) for f in features(w)}
                if marks.isdisjoint(own) and (able := own & strength.keys()):
                    found.append(max(able, key=lambda f: (strength[f], f)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["feature"])

    more = sample.where("toxic = 1").select("text").mapInArrow(best, "feature string").groupBy("feature").agg(F.count("*").alias("n")).where("n >= 2").collect()
    return sorted(marks | {r.feature for r in more})


class Crf:
    """Weights of features and of the two-state chain (0 background, 1 toxic)."""

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -5.0, chain=((0.0, -1.0), (0.0, 1.0)), start: float = -1.0, prior: float = 1.0):
        self.weights, self.bias, self.chain, self.start = weights or {}, bias, np.array(chain, float), start
        #: Training holds about as many sentences with as without toxic words; document scores multiply odds by this.
        self.prior = prior
        self.cache: dict[str, float] = {}
        self.heads = {f[2:5] for f in self.weights if f[1:2] == ":"}
        self.background = float(self.marginals([0.0] * 50).max())

    def gain(self, word: str) -> float:
        """Sum of the weights of a word's features."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            get = self.weights.get
            got = get(word, 0.0)
            if word[:3] in self.heads:
                got += sum(get(f"{n}:{word[:n]}", 0.0) for n in STEMS if len(word) >= n)
            self.cache[word] = got
        return got

    def marginals(self, gains: list[float]) -> np.ndarray:
        """Chances of state 1 by forward-backward, with scaled messages."""
        (m00, m01), (m10, m11) = np.exp(self.chain).tolist()
        odds = [math.exp(min(30.0, max(-30.0, self.bias + g))) for g in gains]
        n = len(odds)
        forward, a0, a1 = [], 1.0, math.exp(self.start)
        for k, o in enumerate(odds):
            x0, x1 = (a0, a1) if not k else (a0 * m00 + a1 * m10, a0 * m01 + a1 * m11)
            x1 *= o
            s = x0 + x1
            a0, a1 = x0 / s, x1 / s
            forward.append(a1)
        out, b0, b1 = np.empty(n), 1.0, 1.0
        for k in range(n - 1, -1, -1):
            one, zero = forward[k] * b1, (1 - forward[k]) * b0
            out[k] = one / (one + zero)
            c0, c1 = b0, b1 * odds[k]
            b0, b1 = m00 * c0 + m01 * c1, m10 * c0 + m11 * c1
            s = b0 + b1
            b0, b1 = b0 / s, b1 / s
        return out

    def read(self, text: str | None) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Marginals of the words of positive weight (the background's, if there are none), and spans (start, end, marginal) of a
        text, in its characters."""
        if not text:
            return [], []
        gain = self.gain
        if not any(gain(w) > 0 for w in words_of(text)):
            return [self.background], []
        seen, spans, at = [self.background], [], 0
        for stop in [*(m.end() for m in SENTENCE.finditer(text)), len(text)]:
            words = list(WORD.finditer(text, at, stop))
            at = stop
            gains = [gain(w[0].lower()) for w in words]
            if not words or max(gains) <= 0:
                continue
            p = self.marginals(gains)
            seen += [float(x) for x, g in zip(p, gains, strict=True) if g > 0]
            k = 0
            while k < len(p):
                if p[k] < 0.5:
                    k += 1
                    continue
                first = k
                while k + 1 < len(p) and p[k + 1] >= 0.5:
                    k += 1
                spans.append((words[first].start(), words[k].end(), float(p[first : k + 1].max())))
                k += 1
        return seen, spans

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and spans of a text."""
        seen, spans = self.read(text)
        return score(seen, self.prior), spans


def score(marginals: list[float], prior: float) -> float:
    """The chance that any of these is toxic, with their odds multiplied by ``prior``."""
    return 1 - math.prod(1 - (prior * p / (prior * p + 1 - p) if p < 1 else 1.0) for p in marginals)


def best_prior(seen: list[tuple[list[float], int]], threshold: float = 0.3) -> float:
    """The prior under which the fewest documents with these marginals and labels fall on the wrong side of the threshold, and among
    such priors the one that makes the labels likeliest."""
    if not any(y for _, y in seen):
        return 1.0
    grid = np.geomspace(1e-4, 100, 61).tolist()
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    loss = lambda c: -sum(math.log(clip(score(m, c)) if y else 1 - clip(score(m, c))) for m, y in seen)
    wrong = lambda c: sum((score(m, c) >= threshold) != (y == 1) for m, y in seen)
    return min(grid, key=lambda c: (wrong(c), loss(c)))


def _fit_shard(sentences: list[tuple[list[list[int]], list[int]]], n_features: int, first: np.ndarray) -> np.ndarray:
    """Weights of the features, bias, chain (01, 10, 11) and start of one shard: AdaGrad on the conditional likelihood,
    from weight 2 for the features in ``first``."""
    n, longest = len(sentences), max(len(y) for _, y in sentences)
    ids = np.full((n, longest, 1 + len(STEMS)), n_features, np.int64)
    y, mask = np.zeros((n, longest)), np.zeros((n, longest), bool)
    for i, (fs, ys) in enumerate(sentences):
        for j, f in enumerate(fs):
            ids[i, j, : len(f)] = f
        y[i, : len(ys)] = ys
        mask[i, : len(ys)] = True
    theta = np.zeros(n_features + 5)
    theta[first] = 2.0
    theta[n_features : n_features + 5] = (-3.0, -1.0, 0.0, 1.0, -1.0)
    seen = np.full(len(theta), 1e-2)
    pairs = mask[:, 1:]
    yes = np.array([((1 - y[:, :-1]) * y[:, 1:] * pairs).sum(), (y[:, :-1] * (1 - y[:, 1:]) * pairs).sum(), (y[:, :-1] * y[:, 1:] * pairs).sum()])
    for _ in range(STEPS):
        w = np.append(theta[:n_features], 0.0)
        odds = np.exp(np.clip(w[ids].sum(-1) + theta[n_features], -30, 30))
        c01, c10, c11 = np.exp(theta[n_features + 1 : n_features + 4])
        m = np.array([[1.0, c01], [c10, c11]])
        psi = np.stack([np.ones_like(odds), odds], -1)
        alpha = np.zeros((longest, n, 2))
        a = np.array([1.0, np.exp(theta[n_features + 4])])[None] * psi[:, 0]
        for t in range(longest):
            if t:
                a = np.where(mask[:, t, None], (alpha[t - 1] @ m) * psi[:, t], alpha[t - 1])
            a = a / a.sum(1, keepdims=True)
            alpha[t] = a
        beta = np.ones((longest, n, 2))
        for t in range(longest - 2, -1, -1):
            b = (beta[t + 1] * psi[:, t + 1]) @ m.T
            b = b / b.sum(1, keepdims=True)
            beta[t] = np.where(mask[:, t + 1, None], b, 1.0)
        p = alpha * beta
        p1 = (p[..., 1] / p.sum(-1)).T * mask
        joint = alpha[:-1, :, :, None] * m[None, None] * (psi[:, 1:].transpose(1, 0, 2) * beta[1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        joint *= pairs.T[:, :, None, None]
        expected = joint.sum((0, 1))
        gap = (p1 - y) * mask
        g = np.zeros_like(theta)
        g[: n_features + 1] = np.bincount(ids.ravel(), np.repeat(gap.ravel(), 1 + len(STEMS)), n_features + 1)
        g[n_features] = gap.sum()
        g[n_features + 1 : n_features + 4] = np.array([expected[0, 1], expected[1, 0], expected[1, 1]]) - yes
        g[n_features + 4] = (p1[:, 0] - y[:, 0]).sum()
        g[:n_features] += 0.01 * theta[:n_features]
        seen += g * g
        theta -= 0.8 * g / np.sqrt(seen)
    return theta


def fit(rows: DataFrame, sample: int = SAMPLE) -> Crf:
    """Learn from ``rows`` (id, text, toxic; none null)."""
    common.ship(rows.sparkSession)
    some = sampled(rows, "id", sample, 23).groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    some = common.written(some, "toxicity-sample")
    marks = marked_features(some)
    if not marks:
        return Crf()
    marked = frozenset(marks)

    # The vocabulary: all features of marked tokens, and so also those they share with harmless words.
    def shared(batches):
        found: set[str] = set()
        for b in batches:
            for t in b.column(0):
                for w in words_of(t.as_py()):
                    own = features(w)
                    if not marked.isdisjoint(own):
                        found.update(own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["feature"])

    vocabulary = sorted({*marks, *(r.feature for r in some.where("toxic = 1").select("text").mapInArrow(shared, "feature string").groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(VOCABULARY).collect())})
    index = {f: i for i, f in enumerate(vocabulary)}

    def shard(table):
        # Sentences with toxic tokens, without but with words of the vocabulary, and others: so many of each.
        chosen, room, plain = [], [PER_SHARD, PER_SHARD, PER_SHARD // 5], 0
        for _, _, t, toxic in sorted(zip(*(table.column(c).to_pylist() for c in ("draw", "id", "text", "toxic")), strict=True)):
            for s in SENTENCE.split(t):
                words = [w.lower() for w in WORD.findall(s)]
                for lo in range(0, len(words), LONGEST):
                    fs = [features(w) for w in words[lo : lo + LONGEST]]
                    ids = [[index[f] for f in x if f in index] for x in fs]
                    y = [int(toxic == 1 and not marked.isdisjoint(x)) for x in fs]
                    kind = 0 if any(y) else 1 if any(ids) else 2
                    plain += kind == 2
                    if room[kind] and (kind < 2 or plain % PLAIN == 1):
                        room[kind] -= 1
                        chosen.append((ids, y))
        size = len(vocabulary)
        theta = _fit_shard(chosen, size, np.array([index[f] for f in marks])) if chosen else np.zeros(size + 5)
        # A shard has a say in a feature's weight by the tokens that it has seen of it.
        said = np.bincount([f for ids, _ in chosen for x in ids for f in x], minlength=size + 5).astype(float)
        said[size:] = max(1, len(chosen))
        return pa.table({"place": pa.array(np.arange(len(theta)), pa.int64()), "weight": pa.array(theta * said, pa.float64()), "said": pa.array(said, pa.float64())})

    toxic_texts = some.where("toxic = 1").count()
    shards = min(SHARDS, max(1, toxic_texts // A_SHARD))
    split = some.withColumn("draw", F.xxhash64(F.lit(3), "id"))

    def learnt(part: DataFrame) -> Crf:
        got = part.groupBy(F.pmod("draw", F.lit(shards)).alias("shard")).applyInArrow(shard, "place long, weight double, said double").groupBy("place").agg((F.sum("weight") / F.greatest(F.sum("said"), F.lit(1.0))).alias("weight")).collect()
        theta = np.zeros(len(vocabulary) + 5)
        for r in got:
            theta[r.place] = r.weight
        bias, c01, c10, c11, start = theta[len(vocabulary) :]
        return Crf({f: float(w) for f, w in zip(vocabulary, theta, strict=False) if abs(w) > 1e-3}, float(bias), ((0.0, c01), (c10, c11)), float(start))

    def marginals(model: Crf):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([model.read(t.as_py())[0] for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["marginals", "toxic"])

        return run

    # The prior comes from documents that the chain was not fitted on, where there are enough.
    model, third = learnt(split), F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(3)) == 0
    apart = toxic_texts >= 3 * LEAST_APART
    judge, judged = (learnt(split.where(~third)), split.where(third)) if apart else (model, split)
    seen = sampled(judged.where("text <> ''"), "id", CALIBRATION, 37).select("text", "toxic").mapInArrow(marginals(judge), "marginals array<double>, toxic int").collect()
    model.prior = best_prior([(list(r.marginals), r.toxic) for r in seen])
    return model


def tagged(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, spans`` for every row; spans are arrays of (start, end, marginal)."""

    def run(batches):
        for b in batches:
            got = [model.tag(t.as_py()) for t in b.column(1)]
            spans = [[{"start": s, "end": e, "marginal": p} for s, e, p in g[1]] for g in got]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    common.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>")


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Learn from the labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (common.fold("id") != 2)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = sampled(known, "id", SAMPLE, 29)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # The sample's ids are bounded by SAMPLE.
    return fit(texts.join(F.broadcast(known), "id"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs``."""
    out = tagged(docs, fit_labelled(docs, labels, id_col, text_col), id_col, text_col)
    return out.select("doc_id", F.coalesce(common.fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model, at = fit_labelled(docs, labels, id_col, text_col), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.tag(t.as_py())[0] < threshold for t in b.column(at)], pa.bool_()))

    common.ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
