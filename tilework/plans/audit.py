"""Audits of the dataset: coordinates, attributions, transfer, sizes, steps, labels and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions import columns as C
from tilework.functions import sequences as S
from tilework.operators import attribution, containment, correlation, leaderboard, quantiles, ranking, resampling, splits, summaries, tiles, transfer
from tilework.operators.shared import dealt, written

from . import comparison, views
from .queries import CANDIDATES, HITS_IN_SOURCE, ITEMS, METHODS, PER_TARGET, RANKED, RAW, RC, RHO, SEQ, SPLIT, SQL, WORD, _hash, _letters, query, r6


@query(f"""WITH {HITS_IN_SOURCE}, best AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY accession) AS rn FROM hits)
SELECT s.record_id, s.source, b.accession AS source_accession, b.pos::INT AS window_start, (b.pos + 29)::INT AS window_end, CASE WHEN b.rev THEN '-' WHEN NOT b.rev THEN '+' END AS strand, CASE WHEN b.accession IS NULL THEN 'no_coord' ELSE 'absolute' END AS coordinate_status
FROM seqs s LEFT JOIN best b ON s.record_id = b.record_id AND b.rn = 1""")
def coordinates(spark, d) -> DataFrame:
    """Every record with the coordinates of its trigger, where it has any; its relative window goes."""
    found = containment.locate_in_source(views.source_records(spark, d), views.references(spark, d))
    records = views.sequences(spark, d).select("record_id", "source", F.lit(40).alias("window_start"), F.lit(69).alias("window_end"))
    return attribution.with_coordinates(records, found)


WORDS = f"""words AS (SELECT CASE item_id % 2 WHEN 0 THEN {WORD} ELSE {RC.format(WORD)} END AS key, v AS value FROM items, LATERAL (VALUES (item_id), (CASE WHEN item_id % 4 = 0 THEN item_id + 1000 END)) t(v) WHERE v IS NOT NULL),
two AS (SELECT key AS kmer, value, 0 AS rev FROM words WHERE key <> '' UNION ALL SELECT {RC.format('key')}, value, 1 FROM words WHERE key <> ''), sets AS (SELECT kmer, rev, list(DISTINCT value) AS targets FROM two GROUP BY ALL),
hits AS (SELECT s.record_id, instr(s.sequence, b.kmer) AS pos, rev, targets FROM seqs s JOIN sets b ON contains(s.sequence, b.kmer)),
first AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos, rev) AS rn FROM hits),
att AS (SELECT s.record_id, s.sequence, CASE WHEN {_hash(0, 's.record_id::VARCHAR')} < 0.7 THEN 'train' ELSE 'test' END AS split, coalesce(s.lang, 'NA') AS category, CASE f.rev WHEN 0 THEN 'forward' WHEN 1 THEN 'revcomp' ELSE 'none' END AS match, f.targets FROM seqs s LEFT JOIN first f ON s.record_id = f.record_id AND f.rn = 1)"""


def _attributed(spark, d, sequences: DataFrame | None = None) -> DataFrame:
    """Each sequence with the set of items whose word it holds first; every fourth item has a second number."""
    word, item = F.substring("sequence", 11, 12), F.col("item_id")
    values = F.filter(F.array(item, F.when(item % 4 == 0, item + 1000)), lambda v: v.isNotNull())
    words = views.item_sequences(spark, d).select(F.when(item % 2 == 0, word).otherwise(S.reverse_complement(word)).alias("key"), F.explode(values).alias("value"))
    s = splits.row_random(views.sequences(spark, d) if sequences is None else sequences)
    hits = containment.window_lookup(s.select(F.col("record_id").alias("seq_id"), "sequence"), words).withColumnRenamed("seq_id", "record_id")
    named = [c for c in ("sequence", "digest") if c in s.columns][-1]
    return s.join(hits, "record_id", "left").select("record_id", F.col(named).alias("sequence"), "split", F.coalesce("lang", F.lit("NA")).alias("category"), F.coalesce("strand", F.lit("none")).alias("match"), F.col("values").alias("targets"))


@query(f"""WITH {SEQ}, {ITEMS}, {WORDS}, o AS (SELECT split, category, match, len(coalesce(targets, [])) AS size, unnest(coalesce(nullif(targets, []), [NULL])) AS target, record_id FROM att)
SELECT split, category, match, count(DISTINCT record_id) AS rows, count(DISTINCT target) AS targets, count(DISTINCT CASE WHEN size > 1 THEN record_id END) AS ambiguous, count(DISTINCT CASE WHEN size = 0 THEN record_id END) AS unmatched FROM o GROUP BY GROUPING SETS ((split, category, match), (split), ())""")
def attribution_audit(spark, d) -> DataFrame:
    """Rows, distinct targets, ambiguous and unmatched rows by split, category and match kind, with totals."""
    return attribution.audit(_attributed(spark, d))


@query(f"""WITH {SEQ}, {ITEMS}, {WORDS}, ids AS (SELECT DISTINCT substr(sequence, 1, (8 + item_id % 20)::INT) AS key, item_id AS value FROM items),
found AS (SELECT s.sequence, w.value, row_number() OVER (PARTITION BY s.record_id ORDER BY length(w.key) DESC, instr(s.sequence, w.key), w.value) AS rn FROM seqs s JOIN ids w ON length(w.key) > 0 AND contains(s.sequence, w.key)),
one AS (SELECT sequence, targets[1] AS target, targets[1] % 10 AS category FROM att WHERE len(targets) = 1), other AS (SELECT sequence, value AS target, value % 10 AS category FROM found WHERE rn = 1)
SELECT count(*) AS rows, count(b.sequence) AS found, round(avg(CASE WHEN b.sequence IS NOT NULL THEN (a.category = b.category)::INT END), 6) AS category_rate, round(avg(CASE WHEN b.sequence IS NOT NULL THEN (a.target = b.target)::INT END), 6) AS target_rate FROM one a LEFT JOIN other b ON a.sequence = b.sequence""")
def attribution_agreement(spark, d) -> DataFrame:
    """Unambiguous attributions by windows against those by the longest identifier, over equal sequences. Sequences are made
    once; what is joined carries their SHA-256 instead of them."""
    kind = lambda df: df.withColumn("category", F.col("target") % 10)
    s = written(views.sequences(spark, d).select("record_id", "lang", "sequence", F.sha2("sequence", 256).alias("digest")), "sequences")
    one = kind(attribution.unambiguous(_attributed(spark, d, s)).select("sequence", F.col("targets")[0].alias("target")))
    words = views.item_sequences(spark, d).select(F.left("sequence", (F.lit(8) + F.col("item_id") % 20).cast("int")).alias("key"), F.col("item_id").alias("value")).distinct()
    longest = containment.longest_match(s.select(F.col("record_id").alias("seq_id"), "sequence"), words).where("value is not null")
    other = kind(s.join(longest, s["record_id"] == longest["seq_id"]).select(F.col("digest").alias("sequence"), F.col("value").alias("target")))
    return attribution.agreement(one, other).select("rows", "found", r6("category_rate").alias("category_rate"), r6("target_rate").alias("target_rate"))


def external_tiles(spark, d) -> DataFrame:
    """Turns of conversations as external tiles of 36 letters, labelled by the length of their text; the turn is the tool's rank."""
    c = views.table(spark, d, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("tile_id"), views.letters(F.col("text")).alias("s"), F.length("text").cast("double").alias("label"), F.col("turn").alias("tool_rank"))
    return rows.where("length(s) >= 36").select("tile_id", F.left("s", F.lit(36)).alias("sequence"), "label", "tool_rank")


@query(f"""WITH t AS (SELECT concat_ws('-', conv_id, turn) AS tile_id, {_letters('text')} AS s, length(text) AS label, turn FROM conversations), x AS (SELECT *, substr(s, 1, 30) AS f, substr(s, 7, 30) AS l FROM t WHERE length(s) >= 36),
m AS (SELECT 'tool' AS method, -turn::DOUBLE AS score, label FROM x UNION ALL SELECT 'gc_first', (30 - length(replace(replace(f, 'G', ''), 'C', ''))) / 30.0, label FROM x UNION ALL SELECT 'gc_last', (30 - length(replace(replace(l, 'G', ''), 'C', ''))) / 30.0, label FROM x UNION ALL SELECT 'random', {_hash(0, 'tile_id')}, label FROM x),
r AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY method ORDER BY label) + (count(*) OVER (PARTITION BY method, label) - 1) / 2.0 AS rb FROM m)
SELECT method, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho, count(*) AS n FROM r GROUP BY method""")
def transfer_rho(spark, d) -> DataFrame:
    """Tool, G+C share of either end and random scores against the label of external tiles."""
    return transfer.transfer(external_tiles(spark, d)).select("method", r6("rho").alias("rho"), "n")


@query(f"""SELECT t.*, CASE source_set WHEN 'line' THEN (WITH {CANDIDATES}, r AS (SELECT target_id, success, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, record_id) AS rn FROM cand) SELECT round(avg(success), 6) FROM r WHERE rn = 1) END AS success_at_1 FROM ({SQL['two_sets']}) t""")
def two_sets_success(spark, d) -> DataFrame:
    """Two candidate sets on one scale-free metric, and success of the first choice on the set that has the label."""
    line = ranking.target_metrics(dealt(views.candidates(spark, d), "target_id")).agg(r6(F.avg("success_at_1")).alias("success_at_1")).withColumn("source_set", F.lit("line"))
    return comparison.two_sets(spark, d).join(line, "source_set", "left")


@query(f"""WITH {CANDIDATES}, methods AS (SELECT cand.* REPLACE (('0x' || substr(md5(seed::VARCHAR || '|' || record_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score), seed AS method FROM cand, range(3) s(seed)), {RANKED}, {PER_TARGET},
mean AS (SELECT target_id, avg(s1) AS s1, avg(s3) AS s3, avg(ndcg10) AS ndcg10, avg(regret10) AS regret10 FROM metrics GROUP BY target_id)
SELECT 'random' AS method, round(avg(s1), 6) AS success_at_1, round(avg(s3), 6) AS success_at_3, round(avg(ndcg10), 6) AS ndcg10, round(avg(regret10), 6) AS regret10, count(*) AS targets FROM mean""")
def seed_metrics(spark, d) -> DataFrame:
    """Metrics of three seeds of one method, averaged per target before they are averaged over targets."""
    runs = F.array(*[F.struct(F.lit(s).alias("seed"), C.unit_hash(s, F.col("record_id")).alias("score")) for s in range(3)])
    c = views.candidates(spark, d).drop("score").withColumn("_r", F.explode(runs)).select("*", "_r.seed", "_r.score", F.lit("random").alias("method"))
    out = leaderboard.over_seeds(c, ks=(1, 3))
    return out.groupBy("method").agg(*[r6(F.avg(x)).alias(x) for x in ("success_at_1", "success_at_3", "ndcg10", "regret10")], F.count("*").alias("targets"))


@query(f"""WITH {CANDIDATES}, l AS (SELECT target_id, on_ - off_ AS a, floor(rel * 4) / 4 AS b, abs(on_ - off_ - floor(rel * 4) / 4) AS res FROM cand),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM l), t AS (SELECT avg((abs(b) < 0.2)::INT) AS share FROM l GROUP BY target_id)
SELECT (SELECT round(corr(ra, rb), 6) FROM r) AS rho, round(avg((sign(a) = sign(b))::INT), 6) AS sign_agreement, round(quantile_cont(res, 0.5), 6) AS median_residual, round(max(res), 6) AS worst_residual, (SELECT round(avg(share), 6) FROM t) AS ambiguous_per_target FROM l""")
def label_agreement(spark, d) -> DataFrame:
    """A coarser second label against the difference of the first two: ranks, signs, residuals, and ambiguity per target."""
    c = views.candidates(spark, d).withColumn("rel", F.floor(F.col("rel") * 4) / 4.0).withColumn("diff", F.col("on") - F.col("off"))
    c = c.withColumn("residual", C.identity_residual(F.col("on"), F.col("off"), F.col("rel")))
    parts = [
        correlation.pooled_spearman(c, "diff", "rel").select(r6("rho").alias("rho")),
        c.agg(r6(F.avg((F.signum("diff") == F.signum("rel")).cast("int"))).alias("sign_agreement")),
        quantiles.percentiles(c, "residual", {"m": 0.5}).select(r6("m").alias("median_residual")),
        c.agg(r6(F.max("residual")).alias("worst_residual")),
        c.groupBy("target_id").agg(F.avg(C.ambiguous(F.col("rel")).cast("int")).alias("s")).agg(r6(F.avg("s")).alias("ambiguous_per_target")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query(f"""WITH {RAW}, u AS (SELECT DISTINCT category, target_id, tile FROM full_ WHERE reason IS NULL), s AS (SELECT category, target_id, lead(tile) OVER (PARTITION BY category, target_id ORDER BY tile) - tile AS d FROM u), t AS (SELECT category, target_id, min(d) AS step FROM s GROUP BY ALL)
SELECT category, array_to_string(list(DISTINCT step ORDER BY step), ',') AS steps, count(*) AS targets FROM t GROUP BY category""")
def steps_by_category(spark, d) -> DataFrame:
    """The distinct smallest steps of the targets of each category."""
    c = views.canonical(spark, d).where("reason is null")
    steps = tiles.tiling_step(c).join(c.select("target_id", "category").distinct(), "target_id")
    return steps.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("step")), ",").alias("steps"), F.count("*").alias("targets"))


@query(f"""WITH {CANDIDATES}, {SPLIT}, s AS (SELECT split, target_id, count(*) AS n, avg(success) AS rate FROM cand JOIN split USING (target_id) GROUP BY ALL)
SELECT split, count(*) AS targets, count(*) FILTER (n >= 10) AS n_10, count(*) FILTER (n >= 30) AS n_30, quantile_cont(n, 0.5)::DOUBLE AS median_n, max(n) AS most, round(avg(rate), 6) AS mean_rate FROM s GROUP BY split""")
def target_sizes(spark, d) -> DataFrame:
    """Sizes and success rates of targets by split."""
    c = views.candidates(spark, d)
    n = F.col("n")
    per = c.join(splits.group_disjoint(c), "target_id").groupBy("split", "target_id").agg(F.count("*").alias("n"), F.avg("success").alias("rate"))
    counts = per.groupBy("split").agg(F.count("*").alias("targets"), F.count_if(n >= 10).alias("n_10"), F.count_if(n >= 30).alias("n_30"), F.max(n).alias("most"), r6(F.avg("rate")).alias("mean_rate"))
    return counts.join(quantiles.percentiles(per, "n", {"median_n": 0.5}, ("split",)), "split")


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, record_id) AS rn FROM cand),
t AS (SELECT target_id, max(CASE WHEN rn <= 3 AND off_ < 0.9 THEN success ELSE 0 END) AS hit, least(3, count(*)) AS spent FROM r GROUP BY target_id),
g AS (SELECT p_brand, avg(hit) AS rate FROM t JOIN part ON p_partkey = target_id GROUP BY p_brand)
SELECT sum(hit)::BIGINT AS hits, sum(spent)::BIGINT AS spent, round(sum(spent) / nullif(sum(hit), 0), 6) AS cost_per_hit, (SELECT round(max(rate) - min(rate), 6) FROM g) AS context_gap FROM t""")
def budget_costs(spark, d) -> DataFrame:
    """Entries spent for each hit within three, and the gap between the best and the worst context."""
    c = views.candidates(spark, d).withColumn("valid", F.col("off") < 0.9)
    hits = ranking.candidate_budget(c, "valid", (3,)).join(c.groupBy("target_id").agg(F.count("*").alias("n")), "target_id")
    return ranking.budget_costs(hits.join(views.groups(spark, d), "target_id"), "success_at_3", 3, "grp").select("hits", "spent", r6("cost_per_hit").alias("cost_per_hit"), r6("context_gap").alias("context_gap"))


@query(f"""WITH {RAW} SELECT event_id::VARCHAR AS raw_id, CASE category WHEN 'random' THEN 'test' ELSE 'train' END AS split, CASE status WHEN 'excluded_no_label' THEN 'retained_no_label' ELSE status END AS status, CASE category WHEN 'virus' THEN tile * 5 END AS window_start, CASE category WHEN 'virus' THEN tile * 5 + length(target_id) END AS window_end
FROM full_ WHERE reason IS NULL AND status <> 'excluded_no_label' AND category <> 'human_TF'""")
def canonical_windows(spark, d) -> DataFrame:
    """Relative windows of labelled records outside one category, with a whole category held out."""
    c = views.canonical(spark, d).where("reason is null and status <> 'excluded_no_label' and category <> 'human_TF'")
    start, end = C.relative_window(F.col("tile"), C.stride(F.col("category")), F.col("target_id"))
    return splits.held_out_group(c, "category", ["random"]).select("raw_id", "split", C.relabelled_status(F.col("status")).alias("status"), start.alias("window_start"), end.alias("window_end"))


@query(f"""WITH {CANDIDATES}, {METHODS}, {RHO} SELECT method, round(min(rho), 6) AS low, round(quantile_cont(rho, 0.025), 6) AS p2_5, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.975), 6) AS p97_5, round(max(rho), 6) AS high, round(stddev_pop(rho), 6) AS std, count(rho) AS n FROM rhos GROUP BY method""")
def rho_spread(spark, d) -> DataFrame:
    """Spread of the per-target correlations, beside that of seeded random scores."""
    rho = written(correlation.spearman(views.methods(views.candidates(spark, d)), ("method", "target_id")), "rho")
    ends = quantiles.percentiles(rho, "rho", {"low": 0.0, "p2_5": 0.025, "median": 0.5, "p97_5": 0.975, "high": 1.0}, ("method",))
    spread = summaries.value_spread(rho, "rho", ("method",))
    return ends.join(spread, "method").select("method", *[r6(c).alias(c) for c in ("low", "p2_5", "median", "p97_5", "high", "std")], "n")


@query(f"WITH {RAW} SELECT category, status, count(*) AS n FROM full_ GROUP BY ALL")
def status_counts(spark, d) -> DataFrame:
    """Records by category and admission status."""
    return summaries.value_counts(views.canonical(spark, d), "category", "status")


@query(f"WITH {CANDIDATES} SELECT target_id, round(avg((rel >= 0)::INT), 6) AS ge_0, round(avg((rel >= 0.5)::INT), 6) AS ge_1 FROM cand GROUP BY target_id")
def threshold_profile(spark, d) -> DataFrame:
    """Shares of each target's candidates over thresholds of relevance."""
    shares = summaries.threshold_shares(views.candidates(spark, d), "rel", [0.0, 0.5], ("target_id",))
    return shares.select("target_id", r6("ge_0").alias("ge_0"), r6("ge_1").alias("ge_1"))


@query(f"""WITH {CANDIDATES}, h AS (SELECT DISTINCT target_id, CASE WHEN {_hash(0, 'record_id')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM cand), both_ AS (SELECT target_id FROM h GROUP BY target_id HAVING count(*) = 2),
k AS (SELECT target_id, row_number() OVER (ORDER BY {_hash(1, 'target_id::VARCHAR')}, target_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT target_id FROM cand)), g AS (SELECT CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS targets FROM k GROUP BY 1)
SELECT 'row' AS split_type, 'test-train' AS pair, count(*) AS shared, (SELECT targets FROM g WHERE split = 'train') AS train_targets, (SELECT targets FROM g WHERE split = 'test') AS test_targets FROM both_""")
def split_overlaps(spark, d) -> DataFrame:
    """Targets in both sides of an 80/20 split by rows, beside the sizes of the 80/20 split by targets, which shares none."""
    c = views.candidates(spark, d)
    shared = splits.pair_overlaps(splits.row_random(c, train=0.8)).select(F.lit("row").alias("split_type"), "pair", F.col("n").alias("shared"))
    by_target = splits.assert_disjoint(c.join(splits.group_disjoint(c, train=0.8, val=0.0, seed=1), "target_id"))
    sizes = splits.manifest(by_target).agg(*[F.max(F.when(F.col("split") == s, F.col("targets"))).alias(f"{s}_targets") for s in ("train", "test")])
    return shared.crossJoin(sizes)  # one row each


@query(f"""WITH {CANDIDATES}, r AS (SELECT target_id, record_id, success, row_number() OVER (PARTITION BY target_id ORDER BY {_hash(5, 'target_id::VARCHAR', 'record_id')}, record_id) AS rn FROM cand)
SELECT target_id, record_id AS first, success FROM r WHERE rn = 1""")
def shuffled_first(spark, d) -> DataFrame:
    """The first candidate of each target in a seeded random order."""
    r = resampling.shuffled_rank(views.candidates(spark, d), seed=5)
    return r.where("rn = 1").select("target_id", F.col("record_id").alias("first"), "success")


@query("""WITH s AS (SELECT l_partkey AS target_id, CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_returnflag = 'A' THEN l_extendedprice END AS a, CASE WHEN l_linestatus = 'F' THEN l_tax END AS b FROM lineitem)
SELECT target_id, round(sum(coalesce(nullif(a, 0), b, 0)), 3) AS zero_missing, round(sum(coalesce(a, b, 0)), 3) AS null_missing, round(sum(coalesce(a, 0)), 3) AS first_only, round(sum(coalesce(nullif(a, 0), nullif(b, 0), 0)), 3) AS chain FROM s GROUP BY target_id""")
def fallback_scores(spark, d) -> DataFrame:
    """Sum of scores of each target under the four rules of what counts as missing."""
    first = F.when(F.col("l_returnflag") == "R", 0.0).when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))
    second = F.when(F.col("l_linestatus") == "F", F.col("l_tax"))
    return views.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("target_id")).agg(*[F.round(F.sum(C.fallback_score(first, second, m)), 3).alias(m) for m in ("zero_missing", "null_missing", "first_only", "chain")])
