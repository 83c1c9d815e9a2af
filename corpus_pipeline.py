"""From raw documents to packed sequences: toxic documents go, repeated lines go, one document of each group of near copies
stays, sources are mixed to their weights, and the rest is packed. Each stage is an operator of ``tilework.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import common
from tilework.llm.crf import without_toxic
from tilework.llm.lines import line_dedup
from tilework.llm.mixing import mix
from tilework.llm.packing import best_fit_pack
from tilework.llm.simhash_wide import near_copy_dedup


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, common.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(line_dedup(docs).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash, and by min-wise values what SimHash's bits do not reach; either way compared by all shingles."""
    return near_copy_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: The stages learn a model and encode with a tokenizer, which SQL can't express; tests compare them with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
