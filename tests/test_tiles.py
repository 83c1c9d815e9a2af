import random

from tilework.operators import ranking, tiles


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(5000)] + [(9000 - k, 8999 - k) for k in range(40)] + [(20, 20)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in tiles.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(got) == 5001 + 41 and all(got[k] == (0 if k <= 5000 else 8960) for k in got)


def test_overlap_components(spark):
    rows = [(f"k{i:02}", f"m{j}") for i in range(40) for j in (i, i + 1)] + [("z1", "alone"), ("z2", "other")]
    got = {r.key: r.component for r in tiles.overlap_components(spark.createDataFrame(rows, "key string, kmer string"), "key", "kmer").collect()}
    assert got == {f"k{i:02}": "k00" for i in range(40)} | {"z1": "z1", "z2": "z2"}


def test_values_that_are_no_numbers(spark):
    nan = float("nan")
    df = spark.createDataFrame([("t", "a", 3.0, nan, 0), ("t", "b", 2.0, 1.0, 1), ("t", "c", nan, 0.5, 0)], "target_id string, record_id string, score double, rel double, success int")
    m = ranking.target_metrics(df).first()
    assert 0 < m.ndcg10 < 1 and m.regret10 == 0.0 and m.top1 == "a"
    front = spark.createDataFrame([("t", "a", 1.0, 1.0), ("t", "b", nan, 0.5), ("t", "c", 0.2, 0.9), ("t", "d", 0.1, nan)], "target_id string, record_id string, on double, off double")
    assert sorted(r.record_id for r in ranking.pareto_front(front).collect()) == ["a", "c"]


def test_strides_in_one_shuffle_whose_tasks_follow_the_rows(spark):
    from tilework.operators.shared import dealt

    df = spark.createDataFrame([(s, p) for s in range(50) for p in (1, 3, 5, 9)] + [(None, 1)] * 4, "source long, pos long")
    many = dealt(df, "source", rows=10)
    assert many.rdd.getNumPartitions() == 21
    out = tiles.stride_modes(many, 1, 4)
    assert {(x.source, x.stride, x.n, x.rn) for x in out.collect()} == {(s, 2, 2, 1) for s in range(50)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
