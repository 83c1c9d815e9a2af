"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after the ASCII blanks ``[\\x20\\x09-\\x0D]`` are deleted; a text is known by the SHA-256
of what remains. Only digests, lengths and ids are moved, texts never are.

A Misra-Gries summary of the digests (Spark's frequent-items sketch: ``counters`` counters a task, merged in two levels) names every
digest with more than about 3 / ``counters`` of the rows, and perhaps some others. A second pass counts the named digests exactly and
finds the row that stays of each: these verified winners are at most ``counters`` / 2 rows, so they are broadcast, and
all their copies are settled on the map side. The other digests go through an ordinary shuffle, where no group is larger than
that share of the rows.

Only DataFrame and SQL functions. Defined results: a null text counts as empty, and all empty or blank texts are one group; of equal
texts the row with the most code points stays, then the one of the smallest id (null last); repeated rows of one id
give a row each, all marked alike; an empty table gives no rows; lengths are of whole texts; other columns are ignored by
:func:`exact_groups` and kept by :func:`exact_dedup`, whatever their names. Texts that are no valid UTF-8 are compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The blanks that do not count (fixed values).
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
COUNTERS = 8192
#: Groups in which the tasks' summaries are merged before the last merge.
MERGES = 64


def normalised(text) -> F.Column:
    """The text without ASCII blanks; empty for null."""
    c = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for blank in BLANKS:
        c = F.replace(c, F.lit(blank), F.lit(""))
    return c


def frequent(keys: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """``key`` (long) of every value with more than about 3 / ``counters`` of the rows, and perhaps of others; ``counters`` / 2 rows at most."""
    named = keys.select(F.col(key).alias("_k"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_m"))
    sketches = named.groupBy("_m").agg(F.expr(f"approx_top_k_accumulate(_k, {counters})").alias("_s"))
    merged = sketches.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_s, {counters})").alias("_s"))  # no row for no rows
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {counters // 2})")).alias("_i")).select(F.col("_i.item").alias(key))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row; the digest is the SHA-256 of the normalised text in hex."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))
    rows = common.written(rows.withColumn("head", F.xxhash64("digest")), "digests")
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    named = rows.join(F.broadcast(frequent(rows, "head", counters)), "head", "left_semi")  # counters / 2 rows at most
    winners = common.written(named.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "winners")
    winners = winners.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size", F.lit(True).alias("heavy"))
    seen = rows.join(F.broadcast(winners), "digest", "left")  # as many rows at most
    light = Window.partitionBy("digest")
    first = F.first("doc_id").over(light.orderBy(F.desc("n"), F.col("doc_id").asc_nulls_last()))
    rest = seen.where("heavy is null").select("doc_id", first.alias("keep_id"), F.count("*").over(light).alias("group_size"), "digest")
    every = seen.where("heavy").select("doc_id", "keep_id", "group_size", "digest").unionByName(rest)
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, in its columns. Ids must be distinct for that; of
    repeated rows of one id each stays or goes."""
    gone = exact_groups(docs, id_col, text_col, counters).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")


ORACLE_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS size, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
