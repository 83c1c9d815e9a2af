"""Anchors: where patterns of any length can begin in texts, found without comparing texts with patterns.

An anchor of a text is the k-letter word with the smallest hash among ``w`` words in a row. A pattern of at least ``k + w - 1``
letters has one in its first ``w`` words, and every text that holds the pattern has the same word as an anchor, since both
sides choose by hash. So a pattern needs one seed, a text keeps about two of ``w + 1`` positions, and the two meet in an equality join on
eight bytes. Patterns are put in classes by length, each with its own ``k`` and ``w``, so that
none is too short; a text is read once for all classes that the patterns need. Where other columns must be equal too, their hash is
mixed into the anchors, so that only anchors of the same key meet.

Before anything is shuffled, texts drop the anchors that are not in a Bloom filter of the patterns' seeds, whose size follows their
number up to a fixed bound. What is left carries the text around it, so that meetings are verified where they are; only
patterns longer than ``PIECE`` letters look at their texts again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Least lengths of the classes.
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 28, 32)
PIECE = 1024
#: Letters of a text that are hashed at once, and rows that are sent on at once.
BLOCK, ROWS = 1 << 20, 20_000
#: Bits of the filter for each seed, and bits at most (8 MB).
BITS, MOST_BITS = 16, 1 << 26
_POS = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15


def shape(least: int) -> tuple[int, int]:
    """``k`` and ``w`` of the class of patterns with ``least`` letters or more."""
    w = max(1, least // 3)
    return least - w + 1, w


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` letters, from hashes of 1, 2, 4, ... letters."""
    part, size, out, have = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                n = min(len(out), max(0, len(part) - have))
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[have : have + n]
            have += size
        size *= 2
        if size > k:
            break
        half = size // 2
        n = max(0, len(part) - half)
        part = part[:n] * np.uint64(pow(_BASE, half, 1 << 64)) + part[half : half + n]
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all runs of ``w`` words; of equal hashes the first place of a run counts."""
    h = word_hashes(codes, k)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < w:  # minimum over runs of twice the width, then of w
        step = min(width, w - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = np.unique(low & _POS).astype(np.int64)
    return at, h[at]


def seed(pattern: pd.Series) -> pd.DataFrame:
    """Class, anchor and its offset of each pattern."""
    n = pattern.str.len().to_numpy()
    least = np.array(CLASSES)[np.searchsorted(CLASSES, n, "right") - 1]
    anchor, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for c in np.unique(least).tolist():
        rows, (k, w) = np.flatnonzero(least == c), shape(c)
        codes = letters("".join(p[:c] for p in pattern.iloc[rows]))
        h = word_hashes(codes, k)[np.arange(len(rows))[:, None] * c + np.arange(w)]  # words inside a pattern only
        first = ((h & ~_POS) | np.arange(w, dtype=np.uint64)).argmin(1)
        anchor[rows], offset[rows] = h[np.arange(len(rows)), first].astype(np.int64), first
    return pd.DataFrame({"least": least.astype(np.int32), "anchor": anchor, "offset": offset.astype(np.int32)})


def _key(keys: Sequence[str]):
    return F.xxhash64(*keys) if keys else F.lit(0).cast("long")


def seeds(patterns: DataFrame, pattern: str = "pattern", keys: Sequence[str] = ()) -> DataFrame:
    """``patterns`` with ``least, anchor, offset``; empty patterns and nulls are left out."""
    kept = patterns.where(F.length(pattern) > 0)
    return kept.withColumn("_s", F.pandas_udf(seed, "least int, anchor long, offset int")(F.col(pattern))).select("*", "_s.least", F.col("_s.anchor").bitwiseXOR(_key(keys)).alias("anchor"), "_s.offset").drop("_s")


def bloom_filter(seeded: DataFrame, count: int) -> np.ndarray:
    """Words of a Bloom filter with two bits for each anchor; its length is a power of two and bounded."""
    bits = 1 << 10
    while bits < min(BITS * count, MOST_BITS):
        bits *= 2
    places = F.explode(F.array(F.col("anchor").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("anchor", 26).bitwiseAND(F.lit(bits - 1))))
    words = seeded.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    got, out = words.toArrow(), np.zeros(bits >> 6, np.uint64)  # at most MOST_BITS / 64 rows
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(anchor), bool)
    for b in (anchor & mask, (anchor >> np.uint64(26)) & mask):
        out &= (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return out


def text_anchors(texts: DataFrame, keys: Sequence[str], classes: Sequence[int], words: np.ndarray, piece: int, text: str = "sequence") -> DataFrame:
    """``seq_id, keys, least, anchor, at, lead, piece`` of the anchors that may be seeds: the piece starts ``lead`` letters before
    the anchor at place ``at`` and goes on for ``piece`` letters after it."""
    kept = texts.select("seq_id", *keys, _key(keys).alias("_key"), F.col(text).cast("string").alias("_text")).where(F.length("_text") >= min(classes))
    schema = T.StructType([*kept.schema.fields[:-2], *T._parse_datatype_string("least int, anchor long, at int, lead int, piece string").fields])
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            own = [b.column(i).take(pa.array(rows["row"], pa.int64())) for i in range(1 + len(keys))]
            new = [pa.array(rows["least"], pa.int32()), pa.array(rows["anchor"], pa.int64()), pa.array(rows["at"], pa.int32()), pa.array(rows["lead"], pa.int32()), pa.array(rows["piece"], pa.string())]
            return pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

        for b in batches:
            rows = {c: [] for c in ("row", "least", "anchor", "at", "lead", "piece")}
            mixed = b.column(1 + len(keys)).to_numpy().view(np.uint64)
            for i, t in enumerate(b.column(2 + len(keys))):
                t = t.as_py()
                codes = letters(t)
                for least in classes:
                    k, w = shape(least)
                    for lo in range(0, max(1, len(codes) - least + 1), BLOCK):
                        at, h = anchors(codes[lo : lo + BLOCK + least - 1], k, w)
                        h = h ^ mixed[i]
                        good = in_filter(shared.value, h)
                        for p, a in zip((at[good] + lo).tolist(), h[good].astype(np.int64).tolist(), strict=True):
                            lead = min(p, w - 1)
                            for c, v in (("row", i), ("least", least), ("anchor", a), ("at", p), ("lead", lead), ("piece", t[p - lead : p + piece])):
                                rows[c].append(v)
                if len(rows["row"]) >= ROWS:
                    yield sent()
                    rows = {c: [] for c in rows}
            yield sent()

    return kept.mapInArrow(run, schema)


def occurrences(texts: DataFrame, patterns: DataFrame, keys: Sequence[str] = (), text: str = "sequence", pattern: str = "pattern") -> DataFrame:
    """Every place of every pattern in every text, as the columns of ``patterns`` with ``seq_id`` and ``pos`` (from 0).

    ``texts`` has seq_id and the text; columns named in ``keys`` are in both tables and must be equal. Empty patterns and nulls
    occur nowhere. A place near a block's edge may come twice.
    """
    seeded = written(seeds(patterns, pattern, keys), "seeds")
    known = seeded.agg(F.count("*").alias("n"), F.max(F.length(pattern)).alias("longest"), F.collect_set("least").alias("classes")).first()
    piece = min(known.longest or 1, PIECE)
    found = text_anchors(texts, keys, sorted(known.classes) or [CLASSES[-1]], bloom_filter(seeded, known.n), piece, text)
    met = found.join(seeded, [*keys, "least", "anchor"]).where(F.col("at") >= F.col("offset"))
    here = F.substring(F.col("piece"), F.col("lead") - F.col("offset") + 1, F.least(F.length(pattern), F.lit(piece)))
    met = met.where(here == F.left(F.col(pattern), F.lit(piece))).withColumn("pos", F.col("at") - F.col("offset"))
    if (known.longest or 0) > piece:
        again = texts.select(F.col("seq_id").alias("_id"), F.col(text).alias("_text"))
        long = met.where(F.length(pattern) > piece).join(again, F.col("seq_id") == F.col("_id")).where(F.substring(F.col("_text"), F.col("pos") + 1, F.length(pattern)) == F.col(pattern))
        met = met.where(F.length(pattern) <= piece).unionByName(long.drop("_id", "_text"))
    return met.select("seq_id", *patterns.columns, "pos")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
