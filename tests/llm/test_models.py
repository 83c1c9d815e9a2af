import os

import numpy as np
import pytest

from tilework.llm import common, crf, langid, linear, quality

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def joined(spark, frame):
    labels = common.table(spark, SF, "labels")
    return frame.join(labels, "doc_id").toPandas()


@tables
def test_language(spark):
    docs = common.table(spark, SF, "documents")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, l) for i in range(40) for t, l in ((f"the cat and the dog {i}", "en"), (f"der hund und die katze {i}", "de"))]
    docs = spark.createDataFrame([(k, t, l, "x") for k, (i, t, l) in enumerate(rows)] + [(900, None, "en", "x"), (901, "", None, "x"), (902, "12 !?", "de", "x"), (903, "the dog and", None, "x"), (904, "z" * 300_000, None, "x"), (905, "½ ² Ⅷ _", "de", "x")], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert len(got) == 86 and {got[i].lang_pred for i in (900, 901, 902, 905)} == {"und"}
    assert got[903].lang_pred == "en" and got[904].lang_pred in ("en", "de")
    nothing = langid.language_id(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


def test_samples_of_any_table(spark):
    """A bound under a millionth of the rows still draws about so many, and a bound over all rows draws all."""
    rows = spark.range(50_000_000)
    assert 5 <= linear.sampled(rows, "id", 20, 17).count() <= 45
    assert linear.sampled(rows.limit(7), "id", 20, 17).count() == 7


def test_chain_marginals_against_enumeration():
    from itertools import product

    model = crf.Crf({"bad": 6.0, "3:wor": 1.0}, -2.0, ((0.0, -0.7), (0.3, 0.9)), -0.4)
    gains = [model.gain(w) for w in ("so", "bad", "word", "here")]
    weight, on = 0.0, np.zeros(4)
    for y in product((0, 1), repeat=4):
        e = y[0] * model.start + sum((model.bias + g) * s for g, s in zip(gains, y)) + sum(model.chain[a][b] for a, b in zip(y, y[1:]))
        weight += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert np.allclose(model.marginals(gains), on / weight)


def test_gradient_learns_the_labels():
    sentences = [([[0], [], [1]], [1, 0, 0]), ([[], [1], []], [0, 0, 0])] * 20
    theta = crf._fit_shard(sentences, 2, np.array([0]))
    assert theta[0] > 2 > theta[1]


def test_spans(spark):
    model = crf.Crf({"idiot": 12.0})
    score, spans = model.tag("What a nice day. You IDIOT said it!")
    assert score > 0.9 and [(a, b) for a, b, _ in spans] == [(21, 26)]
    assert model.tag(None) == (0.0, []) and model.tag("") == (0.0, [])
    assert model.tag("word " * 50_000)[1] == []
    text = "İİİ you idiot, İdiot or IDIOT"
    assert [text[a:b] for a, b, _ in model.tag(text)[1]] == ["idiot", "IDIOT"]


def test_prior_of_documents():
    rng = np.random.default_rng(2)
    seen = [([0.95], int(rng.random() < 0.1)) for _ in range(500)] + [([0.01], 0)] * 500 + [([0.9999999], 1)] * 50
    c = crf.best_prior(seen)
    assert crf.score([0.95], c) < 0.3 and crf.score([0.9999999], c) > 0.9 and crf.best_prior([([0.5], 0)]) == 1.0


def test_contradicting_labels_and_repeated_rows(spark):
    rows = [(i, f"you are a nasty{i % 3} filthyword person" if i % 4 == 0 else f"you are a kind{i % 3} person") for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(4, 0)], "doc_id long, toxic int")
    got = crf.toxicity(docs, labels)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, crf.toxicity(docs.repartition(5), labels.repartition(3)).collect()))
    assert a == b and len(a) == 82 and all(r[3] == (r[0] % 4 == 0) for r in a)


@tables
def test_toxicity(spark):
    got = joined(spark, crf.toxicity(common.table(spark, SF, "documents"), common.table(spark, SF, "labels")))
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit > 0.9 * (held.toxic == 1).sum() and hit > 0.9 * (held.predicted == 1).sum()
    assert (got.predicted == (got.score >= 0.3)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_in_each_language(spark):
    """Held-out and training rows of each language; a mark in nearly every toxic text, whatever its language."""
    d = "/root/testdata/sf0.1"
    docs = common.table(spark, d, "documents").join(common.table(spark, d, "labels").select("doc_id"), "doc_id")
    got = crf.toxicity(docs, common.table(spark, d, "labels")).join(docs.select("doc_id", "lang"), "doc_id").join(common.table(spark, d, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held.predicted[held.toxic == 1].mean() > 0.9 and held.toxic[held.predicted == 1].mean() > 0.9
    for lang, rows in got.groupby("lang"):
        bad = rows[rows.toxic == 1]
        assert bad.predicted.mean() > 0.7, lang
        assert rows.predicted[rows.toxic == 0].mean() < 0.03, lang


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "fine words", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r for r in crf.toxicity(docs, labels).collect()}
    assert got[1].score == got[2].score == 0.0 and got[3].predicted == 0
    assert crf.toxicity(docs.limit(0), labels).count() == 0
    kept = crf.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3


@tables
def test_quality(spark):
    got = joined(spark, quality.quality(common.table(spark, SF, "documents")))
    assert got.kept[got.quality == 1].mean() > 0.97
    assert (~got.kept[got.quality == 0]).mean() > 0.5


def test_label_model_finds_the_careful_labeller():
    rng = np.random.default_rng(8)
    counts: dict[int, int] = {}
    truth = rng.random(4000) < 0.8
    for good in truth:
        v = np.zeros(len(quality.LABELLERS), int)
        if not good:
            v[0] = -1 if rng.random() < 0.9 else 0
            v[1] = -1 if rng.random() < 0.5 else 0
            v[2] = -1 if rng.random() < 0.6 else 0  # of two labellers alone, rates can't be told
        k = quality.pattern(v)
        counts[k] = counts.get(k, 0) + 1
    model = quality.LabelModel(counts)
    assert abs(model.share[1] - 0.8) < 0.1
    bad = np.zeros(len(quality.LABELLERS), int)
    assert model.good(bad) > 0.5
    bad[0] = -1
    assert model.good(bad) < 0.5


def test_label_model_beats_the_majority():
    """Overlapping labellers of unequal accuracy, most of which see nothing in a bad document."""
    rng = np.random.default_rng(9)
    m = len(quality.LABELLERS)
    truth = rng.random(6000) < 0.85
    votes = np.where(rng.random((6000, m)) < 0.9, 1, 0)
    fault = rng.integers(0, m // 2, 6000)
    for i in np.flatnonzero(~truth):
        votes[i, [2 * fault[i], 2 * fault[i] + 1]] = np.where(rng.random(2) < 0.9, -1, 0)
    noisy = rng.random(6000) < 0.05
    votes[noisy, 7] = -1
    counts: dict[int, int] = {}
    for v in votes:
        counts[quality.pattern(v)] = counts.get(quality.pattern(v), 0) + 1
    model = quality.LabelModel(counts)
    right = np.mean([(model.good(v) > 0.5) == t for v, t in zip(votes, truth)])
    assert right > 0.97 > 0.9 > np.mean((votes.sum(1) > 0) == truth) and right > np.mean((votes >= 0).all(1) == truth)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Fine words stand here. " * 30), (4, "x" * 200_000)], "doc_id long, text string")
    got = quality.quality(docs).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(docs.limit(0)).count() == 0
