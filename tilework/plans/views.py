"""The given tables in the roles of the operators' inputs: candidates, sequences, tiles and raw records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions import columns as C
from tilework.functions.sequences import reverse_complement
from tilework.operators.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates of the part they order."""
    on, off = F.col("l_quantity") / 50, F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("target_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        on.alias("on"), off.alias("off"), (on - off).alias("rel"), F.col("l_extendedprice").alias("score"), C.success(on, off).alias("success"),
    )


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))


def labelled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of which some lack a label, with their status and what built-in scorers read."""
    d = table(spark, sf_dir, "lineitem")
    on, off = F.when(F.col("l_tax") > 0, F.col("l_quantity") / 50), F.when(F.col("l_discount") > 0, F.col("l_discount") * 10)
    ident = _line_id()
    return d.select(
        F.col("l_partkey").alias("target_id"), ident.alias("record_id"), on.alias("on"), off.alias("off"), (on - off).alias("rel"), C.success(on, off).alias("success"), C.admission_status(on, off).alias("status"),
        F.translate(ident, "0123456789-", "ACGTACGTAC").alias("trigger"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_extendedprice")).alias("salis"), (F.col("l_tax") * 1000).alias("mfe_off"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submitted method that scores the first lines of orders only, some of them twice."""
    d = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    one = d.select(F.lit("submitted").alias("method"), _line_id().alias("record_id"), (F.col("l_quantity") - F.col("l_discount") * 100).alias("score"))
    return one.unionByName(one.where("score > 30").withColumn("score", F.col("score") / 2))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each target."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_brand").alias("grp"))


def methods(df: DataFrame, names: Sequence[str] = ("price", "random", "oracle")) -> DataFrame:
    """Candidates under three methods, or those of them that are named: their own score, a seeded random one, and the true relevance. They are
    dealt by target before there are three rows of each, so that rankings by method and target need no shuffle of their own."""
    random = C.unit_hash(0, F.col("record_id"))
    scored = F.array(*[F.struct(F.lit(m).alias("method"), s.cast("double").alias("score")) for m, s in (("price", F.col("score")), ("random", random), ("oracle", F.col("rel"))) if m in names])
    return dealt(df, "target_id").select(*[c for c in df.columns if c != "score"], F.explode(scored).alias("_m")).select("*", "_m.method", "_m.score").drop("_m")


#: Letters a to z as nucleotides, in turn.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def letters(text: Column) -> Column:
    """All letters of a text as nucleotides; what is no letter from a to z is left out."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *LETTERS), "[^ACGT]", "")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences of their whole texts; the first 30 letters as trigger."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source", "lang", letters(F.col("text")).alias("sequence"))
    return docs.withColumn("trigger", F.left("sequence", F.lit(30)))


def item_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as sequences of their whole texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", letters(F.col("text")).alias("sequence"))


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trigger of 30 letters from inside each sequence, with its source: as it is, as its reverse complement or backwards, in turn."""
    piece, kind = F.substring("sequence", 41, 30), F.col("record_id") % 3
    s = sequences(spark, sf_dir).where(F.length("sequence") >= 70)
    return s.select("record_id", "source", F.when(kind == 0, piece).when(kind == 1, reverse_complement(piece)).otherwise(F.reverse(piece)).alias("trigger"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sequence as a reference of its source."""
    return sequences(spark, sf_dir).select("source", F.col("record_id").alias("accession"), "sequence")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as tiles of their conversation: the first 30 letters of each, as A and C in turn by pairs of letters."""
    seq = F.left(F.translate(letters(F.col("text")), "GT", "AC"), F.lit(30))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("target_id"), F.col("turn").alias("tile"), seq.alias("trigger"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw string records: an identifier with a tile, two labels of which some are missing."""
    d = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("human_"), "event_type")).when(F.col("event_id") % 11 == 0, F.lit("random_pool")).otherwise(F.col("event_type"))
    source = F.when(F.col("event_id") % 97 == 0, "").otherwise(F.concat_ws("_u", kind, (F.col("user_id") % 50).cast("string")))
    ident = F.when(F.col("event_id") % 89 == 0, F.lit("no-tile")).otherwise(F.concat(source, F.lit("_tile_"), (F.col("event_id") % 400).cast("string")))
    return d.select(
        F.col("event_id").cast("string").alias("raw_id"), source.alias("source_sequence"), ident.alias("sequence_id"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.format_string("%.4f", F.col("value"))).alias("ON"),
        F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.format_string("%.4f", F.col("value") / 3)).alias("OFF"),
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table of the raw records, with a reason where a row is not admitted."""
    from tilework.operators.summaries import reject_reason

    raw = raw_records(spark, sf_dir)
    base, tile = C.tile_parts(C.strip(F.col("sequence_id")))
    on, off = C.safe_double(C.strip(F.col("ON"))), C.safe_double(C.strip(F.col("OFF")))
    df = raw.select("raw_id", F.col("source_sequence").alias("target_id"), base.alias("base"), tile.alias("tile"), on.alias("on"), off.alias("off"), "sequence_id")
    df = df.withColumn("reason", reject_reason(F.col("target_id"), F.col("sequence_id"), F.col("tile"))).withColumn("category", C.category(F.col("target_id")))
    step = C.stride(F.col("category"))
    return df.select("*", C.admission_status(F.col("on"), F.col("off")).alias("status"), (F.col("tile") * step).alias("window_start"), (F.col("on") - F.col("off")).alias("rel"), C.record_key(F.col("target_id"), F.col("tile")).alias("record_id"), (F.col("on").isNotNull() & (F.col("on") > 10)).alias("characterized"))
