import math
import random

import pytest

from tilework.operators import correlation, resampling, splits


def average_ranks(x):
    s = sorted(x)
    return [s.index(v) + (s.count(v) + 1) / 2 for v in x]


def rho(a, b):
    a, b = average_ranks(a), average_ranks(b)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def test_spearman_per_group_and_pooled(spark):
    r = random.Random(2)
    data = [(f"t{i % 3}", float(r.randint(0, 6)), float(r.randint(0, 6))) for i in range(90)]
    df = spark.createDataFrame([*data, ("t0", float("nan"), 1.0), ("t0", None, 1.0), ("one", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("flat", 3.0, 2.0)], "target_id string, score double, rel double")
    got = {x.target_id: x.rho for x in correlation.spearman(df, ("target_id",)).collect()}
    assert set(got) == {"t0", "t1", "t2"}
    for t, value in got.items():
        assert value == pytest.approx(rho([x[1] for x in data if x[0] == t], [x[2] for x in data if x[0] == t]))
    pooled = correlation.pooled_spearman(spark.createDataFrame(data, "target_id string, score double, rel double")).first()
    assert pooled.rho == pytest.approx(rho([x[1] for x in data], [x[2] for x in data]))


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "target_id string, v double")
    got = resampling.bootstrap_means(df, "v", "target_id", replicates=200).first()
    assert got["mean"] == 2 and got.lo <= 2 <= got.hi and got.n == 3
    one = resampling.bootstrap_means(df.where("v = 1"), "v", "target_id", replicates=20).first()
    assert (one["mean"], one.lo, one.hi) == (1.0, 1.0, 1.0)
    none = resampling.bootstrap_means(df.where("v > 9"), "v", "target_id", replicates=20).first()
    assert none.n == 0 and none["mean"] is None and none.lo is None


def test_bootstrap_draws_like_a_bootstrap(spark):
    """Means of resamples spread as those of a plain bootstrap do."""
    r = random.Random(5)
    values = [r.gauss(0, 1) for _ in range(400)]
    df = spark.createDataFrame([(f"t{i:03}", v) for i, v in enumerate(values)], "target_id string, v double")
    got = resampling.bootstrap_means(df, "v", "target_id").first()
    plain = sorted(sum(r.choice(values) for _ in values) / 400 for _ in range(2000))
    assert got["mean"] == pytest.approx(sum(values) / 400) and abs(got.lo - plain[50]) < 0.03 and abs(got.hi - plain[1950]) < 0.03


def test_bootstrap_in_blocks(spark):
    """Many small blocks, a group of one and a group of a few, several values at once."""
    r = random.Random(6)
    values = [r.gauss(0, 1) for _ in range(1500)]
    rows = [("big", f"t{i:04}", v, 2 * v + 1, None if i % 2 else v) for i, v in enumerate(values)] + [("one", "t0", 5.0, 6.0, 7.0), (None, "t0", 1.0, 1.0, 1.0), (None, "t1", 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "method string, target_id string, v double, w double, x double")
    got = {x.method: x for x in resampling.bootstrap_means(df, ["v", "w"], "target_id", ("method",), block=64).collect()}
    plain = sorted(sum(r.choices(values, k=1500)) / 1500 for _ in range(2000))
    big = got["big"]
    assert big.n == 1500 and abs(big.v_lo - plain[50]) < 0.02 and abs(big.v_hi - plain[1950]) < 0.02
    assert big.w_lo == pytest.approx(2 * big.v_lo + 1) and big.w_mean == pytest.approx(2 * big.v_mean + 1)
    assert (got["one"].v_lo, got["one"].v_hi) == (5.0, 5.0) and 1.0 <= got[None].v_lo <= got[None].v_hi <= 3.0
    assert resampling.bootstrap_means(df, "x", "target_id", ("method",), replicates=20).where("method = 'big'").first().n == 750


def test_paired_draws(spark):
    """The interval of a difference is that of the resampled means' differences, much narrower than unpaired ones."""
    r = random.Random(8)
    level = [r.gauss(0, 10) for _ in range(300)]
    rows = [(m, i, x + gain) for i, x in enumerate(level) for m, gain in (("base", 0.0), ("up", 1.0 + r.gauss(0, 0.1)))]
    df = spark.createDataFrame(rows, "method string, target_id long, v double")
    got = resampling.paired_bootstrap(df, "v", "target_id", "method", "base").first()
    alone = {x.method: x for x in resampling.bootstrap_means(df, "v", "target_id", ("method",)).collect()}
    assert got.method == "up" and got.n == 300 and got.hi - got.lo < 0.05 and alone["up"].hi - alone["up"].lo > 1
    assert got["mean"] == pytest.approx(alone["up"]["mean"] - alone["base"]["mean"])


def test_permutation_finds_a_real_order(spark):
    data = [(f"t{t}", f"r{i}", float(i), float(i)) for t in range(5) for i in range(12)]
    df = spark.createDataFrame(data, "target_id string, record_id string, ra double, rb double")
    got = resampling.permutation_test(df, replicates=40).first()
    assert got.observed == pytest.approx(1.0) and got.p == pytest.approx(1 / 41) and got.targets == 5


def test_permutation_against_all_orders(spark):
    from itertools import permutations

    ra, rb = {"a": [1.0, 2.0, 3.0, 4.0], "b": [1.0, 2.0, 3.0]}, {"a": [2.0, 1.0, 3.0, 4.0], "b": [2.0, 3.0, 1.0]}
    df = spark.createDataFrame([(t, str(i), x, y) for t in ra for i, (x, y) in enumerate(zip(ra[t], rb[t]))] + [("flat", "0", 1.0, 1.0), ("flat", "1", 1.0, 2.0)], "target_id string, record_id string, ra double, rb double")
    seen = (rho(ra["a"], rb["a"]) + rho(ra["b"], rb["b"])) / 2
    null = [(rho(x, rb["a"]) + rho(y, rb["b"])) / 2 for x in permutations(ra["a"]) for y in permutations(ra["b"])]
    got = resampling.permutation_test(df).first()
    assert got.observed == pytest.approx(seen) and got.targets == 2 and abs(got.p - sum(n >= seen - 1e-12 for n in null) / len(null)) < 0.03
    assert resampling.permutation_test(df.repartition(5), rows_a_part=1).first() == got


def test_group_disjoint_cut_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i % 101, i) for i in range(500)], "target_id long, record_id long")
    a = {r.target_id: r.split for r in splits.group_disjoint(df).collect()}
    assert a == {r.target_id: r.split for r in splits.group_disjoint(df.repartition(7)).collect()}
    count = {s: list(a.values()).count(s) for s in ("train", "val", "test")}
    assert count == {"train": 70, "val": 15, "test": 16}
    with pytest.raises(ValueError):
        splits.assert_disjoint(splits.row_random(df))
    assert splits.pair_overlaps(df.join(splits.group_disjoint(df), "target_id")).count() == 0


def test_percentiles_by_ranges(spark):
    from tilework.operators import quantiles

    r = random.Random(11)
    rows = [(k, v) for k in ("a", "b", None) for v in [r.choice([r.random(), 0.5, 2.0]) for _ in range(701)]] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    qs = {"low": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = {x.k: x for x in quantiles.percentiles(df, "v", qs, ("k",)).collect()}

    def plain(values, q):
        values = sorted(values)
        spot = (len(values) - 1) * q
        lo, hi = values[math.floor(spot)], values[math.ceil(spot)]
        return lo + (hi - lo) * (spot - math.floor(spot))

    for k in ("a", "b", None, "one"):
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(plain([v for x, v in rows if x == k], q))
    assert got["none"].median is None
    assert quantiles.percentiles(df.where("v > 9"), "v", {"m": 0.5}).collect()[0].m is None
    whole = quantiles.percentiles(df, "v", {"m": 0.3}).first().m
    assert whole == pytest.approx(plain([v for _, v in rows if v is not None], 0.3))


def test_pooled_correlation_by_key(spark):
    r = random.Random(12)
    rows = [(k, float(r.choice([1, 2, 3, r.randint(0, 40)])), float(r.randint(0, 5))) for k in ("x", None) for _ in range(300)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    got = {x.k: x for x in correlation.pooled_spearman(spark.createDataFrame(rows, "k string, score double, rel double"), keys=("k",)).collect()}
    for k in ("x", None):
        assert got[k].rho == pytest.approx(rho([a for x, a, _ in rows if x == k], [b for x, _, b in rows if x == k])) and got[k].n == 300
    assert got["flat"].rho is None


def test_permutation_of_targets_that_share_permutations(spark, monkeypatch):
    """Targets of one batch have orders of their own: the spread of the null is that of independent shuffles, whatever is shared."""
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(resampling, "BATCHES", 500)
    rng = np.random.default_rng(3)
    a, b = rng.random((2000, 6)), rng.random((2000, 6))
    a, b = (x.argsort(1).argsort(1) + 1.0 for x in (a, b))
    rows = [(t, i, float(a[t, i]), float(b[t, i])) for t in range(2000) for i in range(6)]
    df = spark.createDataFrame(rows, "target_id long, record_id long, ra double, rb double")
    got = resampling.permutation_test(df, replicates=3000).first()
    x, y = a - 3.5, b - 3.5
    seen = float((x * y).sum() / 17.5 / 2000)
    assert got.targets == 2000 and got.observed == pytest.approx(seen)
    from math import erfc, sqrt

    normal = erfc(seen * sqrt(2000 * 5 / 2)) / 2  # a uniform shuffle of 6 ranks has a correlation of variance 1 / 5
    assert abs(got.p - normal) < 0.04
    assert resampling.permutation_test(df.repartition(5), replicates=3000, rows_a_part=1000).first().p == got.p
    shifted = df.withColumn("rb", F.when(F.col("target_id") < 150, F.col("ra")).otherwise(F.col("rb")))
    assert resampling.permutation_test(shifted, replicates=3000).first().p < 0.02


def test_groups_are_drawn_for_once_and_read_once(spark):
    """Groups of different sizes in one bundle, several values and several blocks, against draws by the formula, group by group."""
    r = random.Random(5)
    rows = [(g, t, r.random(), r.random()) for g, n in (("a", 300), ("b", 300), ("c", 70), ("d", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "g string, t long, x double, y double")
    calls = spark.sparkContext.accumulator(0)
    seen = df.mapInArrow(lambda bs: ((calls.add(b.num_rows), b)[1] for b in bs), df.schema)
    both = {q.g: q for q in resampling.bootstrap_means(seen, ["x", "y"], "t", ("g",), 60).collect()}
    assert calls.value == len(rows)  # the input is evaluated once
    for g in "abcd":
        values = [(x, y) for h, _, x, y in rows if h == g]
        means = {0: [], 1: []}
        for rep in range(60):
            base = resampling._base(rep + 1)
            places = [resampling._base((base + i * resampling._STEP) & resampling._MASK) % len(values) for i in range(len(values))]
            for k in (0, 1):
                means[k].append(sum(values[p][k] for p in places) / len(values))
        for k, c in ((0, "x"), (1, "y")):
            s = sorted(means[k])
            at = 59 * 0.025
            low = s[int(at)] + (s[int(at) + 1] - s[int(at)]) * (at - int(at))
            assert both[g][f"{c}_lo"] == pytest.approx(low) and both[g].n == len(values)
    blocks = {q.g: q for q in resampling.bootstrap_means(df, "x", "t", ("g",), 200, block=50).collect()}
    assert all(blocks[g].lo <= blocks[g].mean <= blocks[g].hi for g in "abcd")


def test_split_by_last_keys(spark, monkeypatch):
    """Equal to the join with each key's split, whatever the keys' type, also where all keys share a hash and where train or val is empty."""
    from pyspark.sql import functions as F

    for keys, kind in (([None, *range(100)], "long"), ([None, *(f"k{i}" for i in range(40))], "string"), ([7], "long"), ([None], "long")):
        df = spark.createDataFrame([(k, i) for k in keys for i in range(2)], f"target_id {kind}, record_id long")
        for one_hash in (False, True):
            with monkeypatch.context() as m:
                if one_hash:
                    m.setattr(splits, "hash_digits", lambda seed, *k: F.lit("00c0ffee"))
                for shares in ({}, {"train": 0.02, "val": 0.0}, {"train": 0.0, "val": 0.03}):
                    want = sorted(map(tuple, df.join(splits.group_disjoint(df, **shares), "target_id").collect()))
                    assert sorted(map(tuple, splits.with_split(df, **shares).collect())) == want


def test_pooled_correlation_of_shared_and_many_values(spark):
    """One value of either side on half of the rows, many others, keys that are null: with and without a broadcast, and without rows."""
    r = random.Random(5)
    pick = lambda: r.choice([0.0, r.random()])
    rows = [(k, j, pick(), pick()) for k in ("x", None) for j in (1, None) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("x", 1, float("nan"), 1.0), ("x", 1, 1.0, None)], "k string, j long, score double, rel double").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = correlation.pooled_spearman(df, keys=("k", "j")).collect()
            assert len(got) == 4
            for x in got:
                a, b = zip(*[v[2:] for v in rows if v[:2] == (x.k, x.j)])
                assert x.n == 200 and x.rho == pytest.approx(rho(a, b))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    none = correlation.pooled_spearman(df.where("score > 9")).collect()
    assert [tuple(x) for x in none] == [(None, 0)] and not correlation.pooled_spearman(df.where("score > 9"), keys=("k",)).collect()


def test_pooled_ranks_join_no_rows(spark):
    """train_test_rho joins no rows with their ranks of the first side, nor with targets: what is left at the end is counts by value and their ranges."""
    from tilework.plans.queries import QUERIES

    out = QUERIES["train_test_rho"](spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and not any("tilework-pairs" in f for f in out.inputFiles())
    c = spark.createDataFrame([(i % 7, i) for i in range(50)], "target_id long, record_id long")
    plan = splits.with_split(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
