"""The registered queries of this subpackage: thin views on its operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversations, exact, lines, merkle, mixing


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(common.table(spark, sf_dir, "documents"), _tokenizer())


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(common.table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    return line_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    groups = simhash_groups(common.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(common.table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .capdedup import cap_near_duplicates

    return cap_near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(common.table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(common.table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import toxicity

    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).withColumn("spans", F.to_json("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(common.table(spark, sf_dir, "documents"), again=merkle.lower_one_in_five).drop("source")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(common.table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations")
    return conversations.audit(conversations.damaged(turns), ids=turns)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op2_source_mixing": mixing.ORACLE_SQL,
    "op3_line_dedup": lines.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_exact_dedup": exact.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}
