"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words by weight. A target
stops at ``max_epochs`` times its source's size; the excess is shared again by weight. Sorted by
size over weight, the clamped sources are a prefix, so running sums find them in one pass. Every
document is taken ``floor(target / size)`` whole times, and documents in a seeded hash order take one more
until the rest of the target is used; the last of them takes only the words that are left.

Only DataFrame functions. The per-source table has one row a source and is the only thing that is ordered as a
whole; running sums over documents are by source and hash prefix, so that a source holding a third of all rows
spreads over 256 tasks.

Defined results: a null text has size 0; a source of size 0 has target 0; repeated rows count once each;
an empty table gives no rows; other columns are ignored by :func:`mix_plan` and kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``source_key, source_size, target, whole, extra`` per source; ``sizes`` has source, source_key and size."""
    per = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((place - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_epochs))
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.select(
        "*",
        (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(tightest), F.lit(0.0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(tightest), F.lit(0.0))).alias("weight_left"),
    )
    per = per.withColumn("clamped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    clamped = lambda c: F.sum(F.when(F.col("clamped"), F.col(c)).otherwise(0.0)).over(every)
    per = per.withColumn("free_words", F.sum(F.col("source_size").cast("double")).over(every) - clamped("cap"))
    per = per.withColumn("free_weight", F.sum("weight").over(every) - clamped("weight"))
    per = per.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("free_words") / F.col("free_weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return per.withColumn("whole", whole).select("source_key", "source_size", "target", "whole", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).alias("extra"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("draw"),
    )


def mix_plan(docs: DataFrame, max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, source``: the words that the mix takes of each document."""
    sizes = common.written(_sizes(docs, id_col, text_col, source_col).withColumn("part", F.substring("draw", 1, 2)), "sizes")
    parts = sizes.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(Window.partitionBy("source_key").orderBy("part")) - F.col("part_size")
    parts = parts.select("source_key", "part", before.alias("before")).join(source_targets(sizes, max_epochs), "source_key")
    within = Window.partitionBy("source_key", "part").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["source_key", "part"])
    more = F.least(F.greatest(F.col("extra") - F.col("before") - F.col("inside"), F.lit(0)), F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, in the columns of ``docs``: a row for each whole repetition, and for a document of which a
    part is taken one more row with that many leading words joined by spaces. Rows of one id must share text and source."""
    plan = mix_plan(docs, max_epochs, id_col, text_col, source_col).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken")).dropDuplicates(["_id"])
    text = F.col(text_col).cast("string")
    rows = docs.join(plan, docs[id_col].eqNullSafe(plan["_id"]))
    rows = rows.withColumn("_whole", F.when(F.col("_size") > 0, F.expr("_taken div _size")).otherwise(1)).withColumn("_rest", F.col("_taken") - F.col("_whole") * F.col("_size"))
    turns = F.sequence(F.lit(1), (F.col("_whole") + (F.col("_rest") > 0).cast("long")).cast("int"))
    rows = rows.where((F.col("_whole") > 0) | (F.col("_rest") > 0)).withColumn("_turn", F.explode(turns))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut = F.when(F.col("_turn") > F.col("_whole"), F.array_join(F.slice(words, 1, F.col("_rest").cast("int")), " ")).otherwise(text)
    return rows.withColumn(text_col, cut).select(*docs.columns)


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM per),
running AS (
  SELECT *, sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * weight_left <= weight * words_left AS clamped FROM running),
freed AS (
  SELECT *, sum(source_size::DOUBLE) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0.0::DOUBLE END) OVER () AS free_words,
         sum(weight) OVER () - sum(CASE WHEN clamped THEN weight ELSE 0.0::DOUBLE END) OVER () AS free_weight
  FROM marked),
targets AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE weight * free_words / free_weight END AS target FROM freed),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes)
SELECT doc_id, size, source_size, target,
       (whole * size + least(greatest(floor(target - whole * source_size + 0.5)::BIGINT - before, 0), size))::BIGINT AS taken, o.source
FROM ordered o JOIN wholes w ON o.source IS NOT DISTINCT FROM w.source
"""
