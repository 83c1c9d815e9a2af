"""Transfer of methods to an external set of longer tiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions.columns import gc_fraction, unit_hash
from tilework.functions.sequences import crops

from .correlation import pooled_spearman


def transfer(tiles: DataFrame, models: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, length: int = 30) -> DataFrame:
    """``method, rho, n``: rank correlation of every method with the external label over all tiles.

    ``tiles`` has tile_id, sequence, label and tool_rank (best first). Methods are the tool (its rank negated), the G+C share of
    the first and of the last ``length`` letters, a seeded random score, and each of ``models`` on both crops: a fitted model gets the
    crops as rows (``trigger``) and adds ``prediction``.
    """
    first, last = crops(F.col("sequence"), length)
    simple = {"tool": -F.col("tool_rank"), "gc_first": gc_fraction(first, None, length), "gc_last": gc_fraction(last, None, length), "random": unit_hash(0, F.col("tile_id"))}
    scored = F.array(*[F.struct(F.lit(m).alias("method"), c.cast("double").alias("score")) for m, c in simple.items()])
    out = tiles.select("label", F.explode(scored).alias("m")).select("m.method", "m.score", "label")
    cut = F.array(F.struct(F.lit("first").alias("crop"), first.alias("trigger")), F.struct(F.lit("last").alias("crop"), last.alias("trigger")))
    for name, model in (models or {}).items():
        rows = tiles.select("tile_id", "label", F.explode(cut).alias("c")).select("tile_id", "label", "c.crop", "c.trigger")
        out = out.unionByName(model(rows).select(F.concat_ws("_", F.lit(name), "crop").alias("method"), F.col("prediction").alias("score"), "label"))
    return pooled_spearman(out, "score", "label", ("method",))
