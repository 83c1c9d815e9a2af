"""Best-fit packing of token pieces into fixed-size sequences.

Every document is encoded whole, closed by a separator id and cut into pieces of at most ``capacity``
ids. What is packed then depends on the lengths alone, so it is planned on the histogram of lengths:
at most ``capacity`` counts, however many documents there are. Lengths above a third of the capacity pair
at most twice per bin by greedy matching (largest first, with the largest partner that fits); shorter ones
go, longest first, where the least room is left. The plan maps ranges of ranks within a length to
sequences and is bounded by the capacity; ranks come from salted counts, so that no length, however common,
meets in one task.

Defined results: a null or empty text is one piece holding the separator; repeated rows are packed once each;
an empty table gives no rows; other columns are ignored; pieces of equal length are dealt in the order of a hash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALTS = 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""

    def cut(batches):
        from .wordbpe import load

        bpe = load(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), bpe.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data = ids.tobytes() + int(end_id).to_bytes(4, "little")
                    rows += [(doc, k, s // 4, min(4 * capacity, len(data) - s) // 4, zlib.crc32(data[s : s + 4 * capacity])) for k, s in enumerate(range(0, len(data), 4 * capacity))]
                doc, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    common.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, lo, hi, first_sequence, per_sequence, offset)``: the pieces of that length with ranks in
    [lo, hi) go, ``per_sequence`` at a time from ``offset`` on, to the sequences from ``first_sequence`` on."""
    left = {n: c for n, c in counts.items() if c > 0}
    classes: list[list] = []  # [gap, bins, [(length, per bin), ...]]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            room = capacity - n
            mate = next((m for m in large if m <= room and m <= n and left[m] - (m == n) > 0), None)
            if mate is None:
                classes.append([room, left[n], [(n, 1)]])
                left[n] = 0
            elif mate == n:
                classes.append([capacity - 2 * n, left[n] // 2, [(n, 2)]])
                left[n] %= 2
            else:
                pairs = min(left[n], left[mate])
                classes.append([room - mate, pairs, [(n, 1), (mate, 1)]])
                left[n] -= pairs
                left[mate] -= pairs
    gaps = sorted((c[0], i) for i, c in enumerate(classes))
    for n in sorted((m for m in left if 3 * m <= capacity), reverse=True):
        rest = left[n]
        while rest:
            at = bisect_left(gaps, (n, -1))
            if at == len(gaps):
                gap, i = capacity, len(classes)
                classes.append([capacity, -(-rest // (capacity // n)), []])
            else:
                gap, i = gaps.pop(at)
            _, bins, held = classes[i]
            each = gap // n
            full = min(bins, rest // each)
            if full < bins:  # what stays as it is, and one bin for what is left over
                over = rest - full * each if full * each < rest else 0
                if bins - full - bool(over) > 0:
                    classes.append([gap, bins - full - bool(over), list(held)])
                    insort(gaps, (gap, len(classes) - 1))
                if over:
                    classes.append([gap - over * n, 1, [*held, (n, over)]])
                    insort(gaps, (gap - over * n, len(classes) - 1))
            else:
                over = 0
            classes[i] = [gap - each * n, full, [*held, (n, each)] if full else held]
            if full:
                insort(gaps, (gap - each * n, i))
            rest -= full * each + over
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for _, bins, held in classes:
        offset = 0
        for n, each in held if bins else ():
            slots.append((n, used[n], used[n] + bins * each, sequence, each, offset))
            used[n] += bins * each
            offset += n * each
        sequence += bins
    return slots


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (as from :func:`pieces`; it is read three times) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver.
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # At most a few slots for each length.
    slots = F.broadcast(spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, first_sequence long, per_sequence long, slot_offset long"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ranks = groups.select("length", "salt", before.alias("before"))
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("row", row).join(ranks, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    at = F.col("rank") - F.col("lo")
    return ranked.join(slots, ["length"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - lo) div per_sequence")).alias("sequence_id"),
        (F.col("slot_offset") + (at % F.col("per_sequence")) * F.col("length")).alias("offset"),
    )


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(common.written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences than all ids fill, or than there are pieces of over half the capacity."""
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), int(np.sum([c for n, c in counts.items() if 2 * n > capacity])))
