"""Derived columns: parsing, categories, labels, scores and seeded draws. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def safe_double(c: Column) -> Column:
    """The number in a cell, null where there is none."""
    return c.try_cast("double")


def tile_parts(identifier: Column) -> tuple[Column, Column]:
    """Base and number of ``<base>_tile_<N>``, split at the last marker; nulls where there is none."""
    pattern = r"^(.*)_tile_\s*([+-]?[0-9]+)\s*$"
    base = F.when(identifier.rlike(pattern), F.regexp_extract(identifier, pattern, 1))
    return base, F.when(base.isNotNull(), F.regexp_extract(identifier, pattern, 2).try_cast("int"))


def category(name: Column, human: str = "human_TF") -> Column:
    """random, human or virus by prefix; a null name is NA."""
    return F.when(name.isNull(), "NA").when(name.startswith("random"), "random").when(name.startswith("human_"), human).otherwise("virus")


def two_groups(name: Column) -> Column:
    """Human names against everything else."""
    return F.when(name.startswith("human_"), "TF").otherwise("virus")


def stride(kind: Column) -> Column:
    """Step between windows of a category (fixed values)."""
    return F.when(kind == "virus", 5).when(kind == "human_TF", 10)


def relative_window(tile: Column, step: Column, trigger: Column) -> tuple[Column, Column]:
    """Start and end of a window relative to its source."""
    start = tile * step
    return start, F.when(trigger != "", start + F.length(trigger))


def any_filled(*cells: Column) -> Column:
    return F.exists(F.array(*[F.coalesce(c, F.lit("")) for c in cells]), lambda c: c != "")


def admission_status(on: Column, off: Column) -> Column:
    """paired, single or no label."""
    return F.when(on.isNotNull() & off.isNotNull(), "admitted_paired").when(on.isNotNull() | off.isNotNull(), "admitted_single_label").otherwise("excluded_no_label")


def relabelled_status(status: Column) -> Column:
    return F.when(status == "excluded_no_label", "retained_no_label").otherwise(status)


def record_key(source: Column, tile: Column) -> Column:
    return F.concat_ws("__tile_", source, tile.cast("string"))


def gc_fraction(sequence: Column, digits: int | None = 4, over: int | None = None) -> Column:
    """Share of G and C; over a fixed length if given; null for an empty sequence."""
    n = F.regexp_count(sequence, F.lit("[GC]"))
    share = n / F.lit(float(over)) if over else F.when(F.length(sequence) > 0, n / F.length(sequence))
    return share if digits is None else F.round(share, digits)


def coordinate_status(accession: Column) -> Column:
    return F.when(accession.isNotNull(), "absolute").otherwise("no_coord")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(safe_double(c), F.lit(0.0))


def fallback_score(first: Column, second: Column, mode: str = "zero_missing") -> Column:
    """The first score, or the second where the first is missing, or 0.

    ``zero_missing`` takes zeros of the first as missing, ``null_missing`` only nulls, ``first_only`` has no
    second, ``chain`` takes zeros of either as missing.
    """
    zero = F.lit(0.0)
    return {
        "zero_missing": F.coalesce(F.nullif(first, zero), second, zero),
        "null_missing": F.coalesce(first, second, zero),
        "first_only": F.coalesce(first, zero),
        "chain": F.coalesce(F.nullif(first, zero), F.nullif(second, zero), zero),
    }[mode]


def success(on: Column, off: Column, at_least: float = 0.5, at_most: float = 0.5) -> Column:
    """1 if on is high and off is low, else 0; 0 if either is missing."""
    return F.coalesce(((on >= at_least) & (off <= at_most)).cast("int"), F.lit(0))


def header_accession(header: Column) -> Column:
    return F.regexp_extract(header, r"^>?\s*(\S+)", 1)


def identity_residual(on: Column, off: Column, difference: Column) -> Column:
    return F.abs(on - off - difference)


def ambiguous(difference: Column, below: float = 0.2) -> Column:
    return F.abs(difference) < below


def regression_target(y: Column) -> Column:
    return F.log1p(F.greatest(y, F.lit(0.0)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def ranked_score(c: Column) -> Column:
    """A score for ranking: what is not a number comes last."""
    return F.nanvl(c, F.lit(None).cast("double"))


def hash_digits(seed, *keys: Column) -> Column:
    """Eight hexadecimal digits of a seeded hash of a row's key, in the order of :func:`unit_hash`."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def unit_hash(seed, *keys: Column) -> Column:
    """A seeded draw in [0, 1) from a row's key; the same on any partitioning."""
    return F.conv(hash_digits(seed, *keys), 16, 10).cast("double") / F.lit(4294967296.0)
