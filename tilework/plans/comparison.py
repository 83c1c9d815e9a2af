"""Comparisons across methods, splits and candidate sets: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.operators import correlation, leaderboard, ranking, resampling, splits
from tilework.operators.shared import dealt, written

from . import views
from .queries import BASES, CANDIDATES, EVALUATED, METHODS, PER_TARGET, RANKED, RHO, SPLIT, _hash, _mixed, query, r6


@query(f"""WITH {CANDIDATES}, {METHODS}, {RANKED}, t AS (SELECT method, target_id, max(CASE WHEN rn <= 1 THEN success ELSE 0 END) AS s1, max(CASE WHEN rn <= 3 THEN success ELSE 0 END) AS s3,
  max(CASE WHEN rn <= 5 THEN success ELSE 0 END) AS s5, max(CASE WHEN rn <= 10 THEN success ELSE 0 END) AS s10 FROM ranked WHERE method <> 'price' GROUP BY ALL)
SELECT method, round(avg(s1), 6) AS success_at_1, round(avg(s3), 6) AS success_at_3, round(avg(s5), 6) AS success_at_5, round(avg(s10), 6) AS success_at_10, count(*) AS targets FROM t GROUP BY method""")
def ceilings(spark, d) -> DataFrame:
    """Success of perfect and of random ranking within the first 1, 3, 5 and 10."""
    m = ranking.target_metrics(views.methods(views.candidates(spark, d)).where("method <> 'price'"), ("method", "target_id"), (1, 3, 5, 10))
    return m.groupBy("method").agg(*[r6(F.avg(f"success_at_{k}")).alias(f"success_at_{k}") for k in (1, 3, 5, 10)], F.count("*").alias("targets"))


TABLE = f"""{EVALUATED}, {RHO}, unified AS (SELECT * FROM (SELECT method, avg(s1) AS s1 FROM metrics GROUP BY method) JOIN (SELECT method, avg(rho) AS rho FROM rhos GROUP BY method) USING (method))"""


def _unified(spark, d) -> DataFrame:
    m = views.methods(views.candidates(spark, d))
    first = F.min(ranking.choice("score", "record_id", "success")).alias("first")
    per = correlation.spearman_beside(m, ("method", "target_id"), first)
    s1 = F.avg((F.coalesce("first.success", F.lit(0)) == 1).cast("int")).alias("s1")
    return per.groupBy("method").agg(s1, F.avg("rho").alias("rho"), F.count("n").alias("_kept")).where("_kept > 0").drop("_kept")


@query(f"""{TABLE} SELECT method, round(s1, 6) AS success_at_1, round(rho, 6) AS rho, row_number() OVER (ORDER BY s1 DESC, method) AS place, row_number() OVER (ORDER BY rho DESC, method) AS place_by_rho FROM unified""")
def method_order(spark, d) -> DataFrame:
    """Methods in the order of success and of correlation (a row each)."""
    order = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "method"))
    return _unified(spark, d).select("method", r6("s1").alias("success_at_1"), r6("rho").alias("rho"), order("s1").alias("place"), order("rho").alias("place_by_rho"))


@query(f"""{TABLE} SELECT arg_max(method, rho) AS predictor, arg_max(method, s1) AS designer, arg_max(method, rho) = arg_max(method, s1) AS same FROM unified""")
def best_predictor_designer(spark, d) -> DataFrame:
    """The method of the largest mean correlation and that of the largest success, and whether they are one."""
    out = _unified(spark, d).agg(F.max_by("method", "rho").alias("predictor"), F.max_by("method", "s1").alias("designer"))
    return out.withColumn("same", F.col("predictor") == F.col("designer"))


@query(f"""{TABLE}, r AS (SELECT rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0 AS ra, rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho) - 1) / 2.0 AS rb FROM unified)
SELECT CASE WHEN count(*) >= 3 THEN round(corr(ra, rb), 6) END AS rho, count(*) AS methods FROM r""")
def method_rank_correlation(spark, d) -> DataFrame:
    """Rank correlation over methods of success and mean correlation; null under three methods."""
    m = _unified(spark, d).withColumn("one", F.lit(1)).withColumn("ra", correlation.average_rank(["one"], "s1")).withColumn("rb", correlation.average_rank(["one"], "rho"))
    return m.agg(F.when(F.count("*") >= 3, r6(F.corr("ra", "rb"))).alias("rho"), F.count("*").alias("methods"))


@query(f"""WITH {CANDIDATES}, {SPLIT}, two AS (SELECT 'group' AS method, cand.* FROM cand JOIN split USING (target_id) WHERE split <> 'train' UNION ALL SELECT 'row', cand.* FROM cand WHERE {_hash(0, 'record_id')} >= 0.7),
methods AS (SELECT * FROM two), {RHO} SELECT method AS split_type, round(avg(rho), 6) AS rho, count(*) AS targets FROM rhos GROUP BY method""")
def split_stress(spark, d) -> DataFrame:
    """Mean correlation on the test rows of the split by targets and of the split by rows."""
    c = views.candidates(spark, d)
    by_group = c.join(splits.group_disjoint(c), "target_id").where("split <> 'train'").withColumn("split_type", F.lit("group"))
    both = by_group.unionByName(splits.row_random(c).where("split <> 'train'").withColumn("split_type", F.lit("row")))
    return correlation.spearman(both, ("split_type", "target_id")).groupBy("split_type").agg(r6(F.avg("rho")).alias("rho"), F.count("*").alias("targets"))


@query(f"""WITH {CANDIDATES}, sets AS (SELECT 'line' AS method, target_id, record_id, score, rel FROM cand UNION ALL SELECT 'event', user_id, event_id::VARCHAR, value, event_id % 97 FROM events),
methods AS (SELECT * FROM sets QUALIFY count(*) OVER (PARTITION BY method, target_id) >= 5), {RHO} SELECT method AS source_set, round(avg(rho), 6) AS rho, round(avg((rho > 0)::INT), 6) AS share_positive, count(*) AS targets FROM rhos GROUP BY method""")
def two_sets(spark, d) -> DataFrame:
    """Two candidate sets on one scale-free metric, without targets of fewer than five candidates."""
    keep = ("target_id", "record_id", "score", "rel")
    lines = views.candidates(spark, d).select(F.lit("line").alias("source_set"), *keep)
    events = views.table(spark, d, "events").select(F.lit("event").alias("source_set"), F.col("user_id").alias("target_id"), F.col("event_id").cast("string").alias("record_id"), F.col("value").alias("score"), (F.col("event_id") % 97).cast("double").alias("rel"))
    both = dealt(lines.unionByName(events).where("target_id is not null"), "source_set", "target_id")
    enough = both.withColumn("_rows", F.count("*").over(Window.partitionBy("source_set", "target_id"))).where("_rows >= 5")
    rho = correlation.spearman(enough, ("source_set", "target_id"))
    return rho.groupBy("source_set").agg(r6(F.avg("rho")).alias("rho"), r6(F.avg((F.col("rho") > 0).cast("int"))).alias("share_positive"), F.count("*").alias("targets"))


@query(f"""WITH {CANDIDATES}, methods AS (SELECT cand.* REPLACE (v AS score), method FROM cand, LATERAL (VALUES ('price', score), ('on', on_), ('off', off_), ('constant', 1.0)) f(method, v)), {RHO}
SELECT method AS feature, round(avg(rho), 6) AS rho, count(rho) AS targets FROM rhos GROUP BY method""")
def feature_rho(spark, d) -> DataFrame:
    """Mean per-target correlation of each feature with relevance; a constant feature has none."""
    c = views.candidates(spark, d)
    each = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("score")) for k, v in (("price", F.col("score")), ("on", F.col("on")), ("off", F.col("off")), ("constant", F.lit(1.0)))])
    long = c.select("target_id", "record_id", "rel", F.explode(each).alias("x")).select("target_id", "record_id", "rel", "x.feature", "x.score")
    return correlation.spearman(long, ("feature", "target_id")).groupBy("feature").agg(r6(F.avg("rho")).alias("rho"), F.count("rho").alias("targets"))


@query("""WITH r AS (SELECT source, replace(coalesce(lang, ''), 'human_', '') AS name, length(text) AS n FROM documents) SELECT source, name, count(*) AS refs, max(n)::BIGINT AS longest FROM r WHERE n >= 3000 GROUP BY ALL""")
def long_references(spark, d) -> DataFrame:
    """References of at least 3000 letters by source and by name without its prefix."""
    docs = views.table(spark, d, "documents").select("source", F.replace(F.coalesce("lang", F.lit("")), F.lit("human_"), F.lit("")).alias("name"), F.length("text").alias("n"))
    return docs.where("n >= 3000").groupBy("source", "name").agg(F.count("*").alias("refs"), F.max("n").cast("long").alias("longest"))


IDENT = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT)"
BOARD = f"""lab AS (SELECT *, on_ - off_ AS rel, CASE WHEN on_ >= 0.5 AND off_ <= 0.5 THEN 1 ELSE 0 END AS success, translate(record_id, '0123456789-', 'ACGTACGTAC') AS trigger FROM
  (SELECT l_partkey AS target_id, {IDENT} AS record_id, CASE WHEN l_tax > 0 THEN l_quantity / 50 END AS on_, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS off_, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS salis, l_tax * 1000 AS mfe_off FROM lineitem)),
ok AS (SELECT * FROM lab WHERE on_ IS NOT NULL AND off_ IS NOT NULL AND rel IS NOT NULL),
sub AS (SELECT {IDENT} AS record_id, max(l_quantity - l_discount * 100) AS score FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
methods AS (SELECT target_id, record_id, rel, success, 'random' AS method, {_hash(0, 'record_id')} AS score FROM ok
  UNION ALL SELECT target_id, record_id, rel, success, 'gc', (length(trigger) - length(replace(replace(trigger, 'G', ''), 'C', ''))) / length(trigger) FROM ok
  UNION ALL SELECT target_id, record_id, rel, success, 'thermo', coalesce(nullif(salis, 0), mfe_off, 0) FROM ok
  UNION ALL SELECT target_id, record_id, rel, success, 'submitted', coalesce(sub.score, 0) FROM ok LEFT JOIN sub USING (record_id)), {RANKED}, {PER_TARGET}"""
NAMES = {"success_at_1": "s1", "success_at_3": "s3", "success_at_5": "s5", "ndcg10": "ndcg10", "regret10": "regret10"}


def _drawn(rows: str, values: str, replicates: int, group: str = "method") -> str:
    """SQL of a bootstrap over ``rows`` (group, target_id and values): ``vals``, and ``reps`` with the mean of each value and replicate."""
    means = ", ".join(f"avg(v.{c}) AS {c}" for c in values.split(", "))
    return f"""vals AS (SELECT {group}, {values}, row_number() OVER (PARTITION BY {group} ORDER BY target_id) - 1 AS place, count(*) OVER (PARTITION BY {group}) AS size FROM {rows}),
{BASES.format(replicates)}, draws AS (SELECT {group}, rep, {_mixed('((base + place * 40503) & 4294967295)')} % size AS place FROM vals, bases),
reps AS (SELECT d.{group}, d.rep, {means} FROM draws d JOIN vals v ON d.{group} = v.{group} AND d.place = v.place GROUP BY ALL)"""


def _ends(c: str, name: str, digits: int) -> str:
    return f"round(any_value(w.{c}), {digits}) AS {name}mean, round(quantile_cont(r.{c}, 0.025), {digits}) AS {name}lo, round(quantile_cont(r.{c}, 0.975), {digits}) AS {name}hi"


VALUES = ", ".join(NAMES.values())


@query(f"""WITH {BOARD}, {_drawn('metrics', VALUES, 2000)}, w AS (SELECT method, {', '.join(f'avg({c}) AS {c}' for c in NAMES.values())}, count(*) AS n FROM metrics GROUP BY method)
SELECT w.method, {', '.join(_ends(c, k + '_', 4) for k, c in NAMES.items())}, any_value(w.n) AS n FROM w JOIN reps r USING (method) GROUP BY w.method""")
def leaderboard_table(spark, d) -> DataFrame:
    """Built-in and submitted methods over admitted candidates: success, NDCG and regret with their intervals."""
    rows = leaderboard.evaluable(views.labelled_candidates(spark, d))
    scored = leaderboard.all_scores(rows, ["random", "gc", "thermo"], views.submissions(spark, d))
    return leaderboard.leaderboard(leaderboard.per_target(scored))


@query(f"""WITH {CANDIDATES}, {METHODS}, {RHO}, {_drawn('rhos', 'rho', 1000)}, w AS (SELECT method, avg(rho) AS rho, count(*) AS n, avg((rho > 0)::INT) AS share FROM rhos GROUP BY method)
SELECT w.method, any_value(w.n) AS n, {_ends('rho', '', 6)}, round(any_value(w.share), 6) AS share_positive FROM w JOIN reps r USING (method) GROUP BY w.method""")
def rho_intervals(spark, d) -> DataFrame:
    """Mean per-target correlation of each method with a bootstrap interval of 1000 resamples, and the share above 0."""
    rho = written(correlation.spearman(views.methods(views.candidates(spark, d)), ("method", "target_id")), "rho")
    ends = resampling.bootstrap_means(rho, "rho", "target_id", ("method",), 1000)
    share = rho.groupBy("method").agg(r6(F.avg((F.col("rho") > 0).cast("int"))).alias("share_positive"))
    return ends.join(share, "method").select("method", "n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")], "share_positive")


@query(f"""{EVALUATED}, deltas AS (SELECT a.method, a.target_id, a.ndcg10 - b.ndcg10 AS delta FROM metrics a JOIN metrics b USING (target_id) WHERE a.method <> 'random' AND b.method = 'random'), {_drawn('deltas', 'delta', 2000)},
w AS (SELECT method, avg(delta) AS delta, count(*) AS n FROM deltas GROUP BY method) SELECT w.method, {_ends('delta', '', 6)}, any_value(w.n) AS n FROM w JOIN reps r USING (method) GROUP BY w.method""")
def paired_bootstrap(spark, d) -> DataFrame:
    """Bootstrap interval of each method's mean NDCG above the random method's, both resampled with the same draws."""
    m = ranking.target_metrics(views.methods(views.candidates(spark, d)), ("method", "target_id"))
    out = resampling.paired_bootstrap(m, "ndcg10", "target_id", "method", "random")
    return out.select("method", *[r6(c).alias(c) for c in ("mean", "lo", "hi")], "n")


@query(f"""WITH {CANDIDATES}, {SPLIT}, r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY split ORDER BY rel) + (count(*) OVER (PARTITION BY split, rel) - 1) / 2.0 AS rb FROM cand JOIN split USING (target_id))
SELECT split, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho, count(*) AS n FROM r GROUP BY split""")
def train_test_rho(spark, d) -> DataFrame:
    """Rank correlation over all candidates of each side of the split by targets: one method, train against test."""
    c = views.candidates(spark, d)
    return correlation.pooled_spearman(splits.with_split(c), keys=("split",)).select("split", r6("rho").alias("rho"), "n")
