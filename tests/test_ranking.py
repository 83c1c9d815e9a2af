"""Golden values of the metrics, ties, missing scores and partition counts."""

import random

import pytest
from pyspark.sql import functions as F

from tilework.operators import ranking

SCHEMA = "target_id string, record_id string, score double, rel double, success int, on double, off double"


def rows(spark, order, rel=None, ok=(), target="t"):
    rel = rel or {}
    return spark.createDataFrame([(target, r, float(len(order) - i), float(rel.get(r, 0)), int(r in ok), None, None) for i, r in enumerate(order)], SCHEMA)


@pytest.mark.parametrize("order,ok,k,expected", [("bac", "b", 1, 1), ("acb", "b", 2, 0), ("abc", "b", 2, 1)])
def test_success(spark, order, ok, k, expected):
    got = ranking.target_metrics(rows(spark, order, ok=ok), ks=(k,)).first()
    assert got[f"success_at_{k}"] == expected


def test_ndcg_and_regret(spark):
    rel = {"a": 3, "b": 2, "c": 1}
    assert ranking.target_metrics(rows(spark, "abc", rel), depth=3).first().ndcg3 == 1.0
    assert ranking.target_metrics(rows(spark, "cba", rel), depth=3).first().ndcg3 < 1.0
    assert ranking.target_metrics(rows(spark, "ab", {}), depth=3).first().ndcg3 == 0.0
    assert ranking.target_metrics(rows(spark, "ab", {"a": 1}), depth=1).first().regret1 == 0.0
    assert ranking.target_metrics(rows(spark, "ba", {"a": 1}), depth=1).first().regret1 == 1.0
    assert ranking.target_metrics(rows(spark, "ab", {"a": 3, "b": 3}), depth=1).first().regret1 == 0.0


def test_no_candidates(spark):
    assert ranking.target_metrics(spark.createDataFrame([], SCHEMA)).count() == 0


def test_missing_scores_come_last_and_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([("t", "a", None, 0.0, 0, None, None), ("t", "b", float("nan"), 0.0, 0, None, None), ("t", "d", 1.0, 0.0, 0, None, None), ("t", "c", 1.0, 0.0, 0, None, None)], SCHEMA)
    got = [r.record_id for r in ranking.rank_candidates(df).orderBy("rn").collect()]
    assert got == ["c", "d", "a", "b"]


@pytest.mark.parametrize("points,front", [([(1, 0.1), (0.8, 0.1), (0.5, 0.9)], 1), ([(1, 0.9), (0.5, 0.1)], 2), ([(1, 0.1), (1, 0.1), (0.5, 0.5)], 2), ([(None, 0.1), (1, None)], 0), ([], 0)])
def test_pareto(spark, points, front):
    df = spark.createDataFrame([("t", str(i), 0.0, 0.0, 0, None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(points)], SCHEMA)
    assert ranking.pareto_front(df).count() == front


def test_partitioning_does_not_matter(spark):
    import random

    r = random.Random(1)
    data = [(f"t{i % 7}", f"r{i}", float(r.randint(0, 5)), r.random(), r.randint(0, 1), r.random(), r.random()) for i in range(300)]
    a, b = (sorted(map(tuple, ranking.target_metrics(spark.createDataFrame(data, SCHEMA).repartition(n)).collect())) for n in (1, 8))
    assert a == b


def test_budget_counts_invalid_and_repeated_entries(spark):
    df = spark.createDataFrame([("t", "a", 3.0, 1, False), ("t", "b", 2.0, 1, True), ("t", "b", 1.0, 1, True)], "target_id string, record_id string, score double, success int, ok boolean")
    got = ranking.candidate_budget(df, "ok", (1, 2)).first()
    assert (got.success_at_1, got.success_at_2) == (0, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_front_against_all_pairs_in_one_shuffle(spark):
    import math
    import random

    r = random.Random(8)
    pick = lambda: r.choice([0.0, -0.0, 0.5, 1.0, 1.5, 2.0, math.nan, math.inf, None])
    rows = [(t, f"r{i}", pick(), pick()) for t in range(40) for i in range(9)]
    df = spark.createDataFrame(rows, "target_id long, record_id string, on double, off double")
    known = lambda x: x[2] is not None and x[3] is not None and not math.isnan(x[2]) and not math.isnan(x[3])
    beats = lambda a, b: a[0] == b[0] and a[2] >= b[2] and a[3] <= b[3] and (a[2] > b[2] or a[3] < b[3])
    want = {x[:2] for x in rows if known(x) and not any(known(y) and beats(y, x) for y in rows)}
    front = ranking.pareto_front(df)
    assert {(x.target_id, x.record_id) for x in front.collect()} == want
    assert _plan(front).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in _plan(front)


def test_choice_is_the_row_of_rank_one(spark):
    import math
    import random

    from pyspark.sql import functions as F

    r = random.Random(9)
    table = [(m, t, f"r{i}", r.choice([0.0, -0.0, 1.0, 2.0, math.nan, None])) for m in "ab" for t in range(60) for i in range(3)]
    df = spark.createDataFrame(table, "method string, target_id long, record_id string, score double")
    want = {(x.method, x.target_id): x.record_id for x in ranking.top_k(df, 1, ("method", "target_id")).collect()}
    got = df.groupBy("method", "target_id").agg(F.min(ranking.choice("score", "record_id")).alias("c"))
    assert {(x.method, x.target_id): x.c.record_id for x in got.collect()} == want
    one = ranking.top1_agreement(df, "a", "b")
    assert one.first().agreement == sum(want["a", t] == want["b", t] for t in range(60)) / 60 and one.first().n == 60
    assert "Window" not in _plan(one)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_correlation_beside_other_aggregates(spark):
    """Equal to the correlation alone, with values missing on either side, ties, and groups that are left out; all rows count beside it."""
    from tilework.operators import correlation

    nan, r = float("nan"), random.Random(3)
    pick = lambda: r.choice([None, nan, 0.0, -0.0, 1.0, 2.0, 3.0])
    table = [(m, t, f"r{i}", pick(), pick(), i % 2) for m in ("a", "b") for t in range(12) for i in range(r.randint(1, 9))] + [("c", 1, "x", 1.0, nan, 1)]
    df = spark.createDataFrame(table, "method string, target_id long, record_id string, score double, rel double, success int")
    want = {(x.method, x.target_id): (x.rho, x.n) for x in correlation.spearman(df, ("method", "target_id")).collect()}
    got = correlation.spearman_beside(df, ("method", "target_id"), F.count("*").alias("all"), F.min(ranking.choice("score", "record_id", "success")).alias("first")).collect()
    first = {(x.method, x.target_id): x.success_at_1 for x in ranking.target_metrics(df, ("method", "target_id")).collect()}
    assert want and len(got) == 25 and sum(x["all"] for x in got) == len(table)
    assert {(x.method, x.target_id): (x.rho, x.n) for x in got if x.n is not None} == want
    assert {(x.method, x.target_id): x.first.success for x in got} == first


def test_methods_are_ranked_in_few_sorts(spark):
    """method_order reads its candidates once and ranks each side in one window, paired_delta leaves out the third method, and both sort by target before method."""
    from tilework.plans.queries import QUERIES
    from tilework.plans.comparison import _unified

    order, delta = plan(_unified(spark, "/root/testdata/sf0.001")), plan(QUERIES["paired_delta"](spark, "/root/testdata/sf0.001"))
    assert order.count("Relation [") == 1 and order.count("Window [") == 2 and "oracle" in order
    assert "oracle" not in delta and "windowspecdefinition(method" not in order + delta
