import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tilework.functions import columns as C
from tilework.operators import attribution, leaderboard, models, ranking, resampling, splits, summaries, transfer
from tilework.sources import readers, writers

COORDS = "record_id string, source_accession string, window_start int, strand string"


def test_coordinates(spark):
    records = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old"), (None, 3, "old")], "record_id string, window_start int, coordinate_status string")
    coords = spark.createDataFrame([("a", "acc", 7, "+"), ("z", "acc", 9, "-")], COORDS)
    seen = Observation("coordinates")
    out = attribution.with_coordinates(records, coords, seen)
    assert out.columns == ["record_id", "source_accession", "window_start", "strand", "coordinate_status"]
    assert {tuple(r) for r in out.collect()} == {("a", "acc", 7, "+", "absolute"), ("b", None, None, None, "no_coord"), (None, None, None, None, "no_coord")}
    assert seen.get == {"keys": 2, "most": 1}
    with pytest.raises(PySparkException, match="more than one row of coordinates for a"):
        attribution.with_coordinates(records, coords.union(coords.where("record_id = 'a'"))).collect()
    assert attribution.with_coordinates(records, coords.limit(0)).where("coordinate_status = 'no_coord'").count() == 3


def test_attribution_sets(spark):
    rows = [("train", "x", "forward", [1, 2]), ("train", "x", "forward", [2]), ("test", "x", "none", None), ("test", "y", "none", []), ("test", "y", "revcomp", [3])]
    df = spark.createDataFrame(rows, "split string, category string, match string, targets array<int>")
    got = {(r.split, r.category, r.match): (r.rows, r.targets, r.ambiguous, r.unmatched) for r in attribution.audit(df).collect()}
    assert got[("train", "x", "forward")] == (2, 2, 1, 0) and got[("test", "x", "none")] == (1, 0, 0, 1) and got[("test", "y", "none")] == (1, 0, 0, 1)
    assert got[("test", None, None)] == (3, 1, 0, 2) and got[(None, None, None)] == (5, 3, 1, 2)
    assert attribution.unambiguous(df).count() == 2


def test_agreement_fans_out(spark):
    one = spark.createDataFrame([("s", "c", 1), ("s", "c", 2), ("t", "c", 1)], "sequence string, category string, target int")
    other = spark.createDataFrame([("s", "c", 1), ("s", None, 1)], "sequence string, category string, target int")
    r = attribution.agreement(one, other).first()
    assert (r.rows, r.found, r.category_rate, r.target_rate) == (5, 4, 0.5, 0.5)


def test_transfer_with_a_model(spark):
    """A model that counts G in a crop follows labels made of the last crop; the tool's rank is negated."""
    r = random.Random(4)
    rows = []
    for i in range(200):
        s = "".join(r.choice("ACGT") for _ in range(36))
        rows.append((f"t{i}", s, float(s[-30:].count("G")), 40 - s[-30:].count("G")))
    tiles = spark.createDataFrame(rows, "tile_id string, sequence string, label double, tool_rank int")
    train = [("".join(r.choice("ACGT") for _ in range(30)),) for _ in range(500)]
    fit = models.sequence_model(spark.createDataFrame(train, "trigger string").withColumn("y", F.regexp_count("trigger", F.lit("G")).cast("double")), "trigger", "y")
    got = {x.method: x for x in transfer.transfer(tiles, {"linear": fit}).collect()}
    assert set(got) == {"tool", "gc_first", "gc_last", "random", "linear_first", "linear_last"} and all(x.n == 200 for x in got.values())
    assert got["tool"].rho == pytest.approx(1.0) and got["linear_last"].rho > 0.95 > got["linear_first"].rho and abs(got["random"].rho) < 0.25


def test_structure_columns_help_where_they_matter(spark):
    """Ablation: with a column that decides the label, errors on test rows vanish; without it they do not."""
    r = random.Random(5)
    rows = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(30)), x, 3 * x + 1) for i in range(400) for x in [r.random()]]
    df = splits.row_random(spark.createDataFrame(rows, "record_id string, trigger string, fold_energy double, y double"))
    from tilework.operators.correlation import regression_errors

    r2 = lambda extra: {x.split: x.r2 for x in regression_errors(models.sequence_regressor(df, "trigger", "y", extra), ("split",)).collect()}
    assert r2(["fold_energy"])["test"] > 0.95 > 0.5 > r2([])["test"]


def test_trees_beat_the_mean(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        s = "".join(r.choices("ACGT", weights=[r.random() + 0.05 for _ in range(4)], k=40))
        rows.append((f"r{i}", s, s.count("G") / 40))
    from tilework.operators.correlation import regression_errors

    df = splits.row_random(spark.createDataFrame(rows, "record_id string, sequence string, y double"))
    err = {x.split: x for x in regression_errors(models.composition_regressor(df, "sequence", "y", trees=10), ("split",)).collect()}
    mean = {x.split: x for x in regression_errors(models.constant_mean(df, "y"), ("split",)).collect()}
    assert err["test"].r2 > 0.8 > mean["test"].r2 and err["test"].mae < mean["test"].mae / 2


def test_scores_of_methods(spark):
    rows = [(f"r{i}", "t" if i < 6 else "u", "admitted_paired" if i else "admitted_single_label", float(i), "ACGG"[i % 4 :], 0.0 if i % 2 else 5.0, float(i), int(i == 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "record_id string, target_id string, status string, rel double, trigger string, salis double, mfe_off double, success int")
    good = leaderboard.evaluable(df)
    assert good.count() == 9
    sub = spark.createDataFrame([("m", "r3", 9.0), ("m", "r3", 1.0), ("m", "nobody", 5.0)], "method string, record_id string, score double")
    scored = leaderboard.all_scores(good, ["random", "gc", "thermo"], sub)
    assert scored.count() == 36
    got = {r.record_id: r.score for r in scored.where("method = 'm'").collect()}
    assert got["r3"] == 9.0 and sum(v == 0 for v in got.values()) == 8
    assert {r.record_id: r.score for r in scored.where("method = 'thermo'").collect()}["r3"] == 3.0
    with pytest.raises(ValueError, match="no scorer"):
        leaderboard.all_scores(good, ["unknown"])
    board = {r.method: r for r in leaderboard.leaderboard(leaderboard.per_target(scored), replicates=50).collect()}
    assert board["m"].success_at_1_mean == 0.5 and board["m"].success_at_1_lo <= 0.5 <= board["m"].success_at_1_hi and board["m"].n == 2


def test_budget_and_order(spark):
    rows = [("t", "a", 1, 5, "x"), ("u", "b", 0, 2, "x"), ("v", "c", 1, 3, "y")]
    per = spark.createDataFrame(rows, "target_id string, top string, hit int, n long, grp string")
    r = ranking.budget_costs(per, "hit", 3, "grp").first()
    assert (r.hits, r.spent, r.cost_per_hit, r.context_gap) == (2, 8, 4.0, 0.5)
    some = spark.createDataFrame([("t", f"r{i}") for i in range(20)], "target_id string, record_id string")
    one, two = (resampling.shuffled_rank(some.repartition(n), seed=3).orderBy("record_id").collect() for n in (1, 5))
    assert one == two and sorted(r.rn for r in one) == list(range(1, 21)) and [r.rn for r in one] != list(range(1, 21))


def test_small_rules(spark):
    df = spark.createDataFrame([("a", 0.12344, 0.5, 1.0), ("b", 0.2, 0.5, 1.0)], "record_id string, on double, off double, rel double")
    other = spark.createDataFrame([("z", 0.123441, 0.50001, 1.0)], "record_id string, on double, off double, rel double")
    assert [tuple(r)[3:] for r in summaries.triple_match(df, other).collect()] == [("a", "z")]
    assert {tuple(r) for r in summaries.threshold_shares(df, "on", [0.15, 0.1]).collect()} == {(0.5, 1.0)}
    assert spark.range(1).select(C.any_filled(F.lit(""), F.lit(None).cast("string")), C.any_filled(F.lit(""), F.lit("3")), C.number_or_zero(F.lit("x")), C.regression_target(F.lit(-2.0))).first()[:] == (False, True, 0.0, 0.0)
    assert C.finite(F.lit(1.0)) is not None and splits.pair_overlaps(spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "target_id string, split string")).first()[:] == ("a-b", 1)


def test_files(spark, tmp_path):
    """CSV with casts, files of splits, a compressed dictionary, submissions, metric tables of several runs, a CSV sink and a stream."""
    import gzip

    (tmp_path / "n.csv").write_text("id,v\na,1.5\nb,x\n")
    assert [tuple(r) for r in readers.string_csv(spark, f"{tmp_path}/n.csv", {"v": "double"}).collect()] == [("a", 1.5), ("b", None)]
    for s in ("train", "test"):
        (tmp_path / f"{s}.csv").write_text(f"sequence,ON\nAC,{len(s)}\n")
    got = readers.split_files(spark, {s: f"{tmp_path}/{s}.csv" for s in ("train", "test")}, "sequence string, ON double")
    assert {tuple(r) for r in got.collect()} == {("AC", 5.0, "train"), ("AC", 4.0, "test")}
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("key,value\n" + "".join(f"k{i},{i}\n" for i in range(100)))
    assert readers.gzip_dictionary(spark, f"{tmp_path}/d.csv.gz", 4).where("key = 'k7' and value = '7'").count() == 1
    writers.csv(spark.createDataFrame([("r1", 0.5), ("r2", None)], "record_id string, score double"), f"{tmp_path}/sub")
    assert {tuple(r) for r in readers.submission(spark, f"{tmp_path}/sub").collect()} == {("r1", 0.5), ("r2", None)}
    writers.parquet(spark.createDataFrame([("m", 1.0)], "method string, rho double"), f"{tmp_path}/m1")
    writers.parquet(spark.createDataFrame([("n", 2.0, 3)], "method string, rho double, n int"), f"{tmp_path}/m2")
    assert readers.prior_metrics(spark, f"{tmp_path}/m1", f"{tmp_path}/m2").where("n is null").count() == 1
    assert readers.canonical(spark, f"{tmp_path}/m1").count() == 1

    from tilework import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("method,record_id,score\nm,r1,0.5\nm,r2,\nn,r1,1\n")
    q = streaming.coverage(streaming.submissions(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("coverage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("coverage").collect()} == {("m", 2, 1), ("n", 1, 0)}


def test_features_are_made_once(spark):
    """Rows of a model come through their functions once, however often training reads them."""
    import random

    from tilework.operators import models

    r = random.Random(4)
    rows = [(str(i), "".join(r.choice("ACGT") for _ in range(30)), float(i % 7), "train" if i % 3 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, trigger string, y double, split string")
    for model in (models.sequence_regressor, lambda *a: models.composition_regressor(*a, trees=2)):
        calls = spark.sparkContext.accumulator(0)
        seen = df.mapInArrow(lambda bs: ((calls.add(b.num_rows), b)[1] for b in bs), df.schema)  # noqa: B023
        assert model(seen, "trigger", "y").count() == len(rows) and calls.value == len(rows)


def test_agreement_makes_sequences_once(spark, monkeypatch):
    from tilework.plans import audit, views
    from tilework.plans.queries import QUERIES

    calls, made = spark.sparkContext.accumulator(0), views.sequences

    def seen(spark, d):
        df = made(spark, d)
        return df.mapInArrow(lambda bs: ((calls.add(b.num_rows), b)[1] for b in bs), df.schema)

    monkeypatch.setattr(audit.views, "sequences", seen)
    assert QUERIES["attribution_agreement"](spark, "/root/testdata/sf0.001").count() == 1 and calls.value == made(spark, "/root/testdata/sf0.001").count()
