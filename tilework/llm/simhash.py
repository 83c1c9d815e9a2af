"""SimHash near-deduplication over an inverted index of positional bytes with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits share at least ``8 - max_bits`` of their eight bytes at
the same positions: the guaranteed minimum of matches. The index therefore lists fingerprints under small sets of
positional bytes, chosen so that every pair with the guaranteed minimum meets under at least one set (posting lists of
single bytes would hold n / 256 rows each, and their pairs grow with the square of the input). The tally of a pair is taken
where it meets, over all eight positions at once: pairs below the minimum are left, the rest are verified by counting bits. Since whatever
verifies has the minimum, the tally spares work and decides nothing. A long list is dealt again by a further shared byte.

Documents with equal fingerprints are one node. A list yields links that span its connected parts, found by
spreading from one fingerprint over those not yet reached, so that a group of near copies yields as many
links as members and not their pairs; all links of all lists connect exactly what the pairs within ``max_bits`` connect.

Defined results: a null or empty text has the fingerprint 0 and is linked like any other; repeated rows keep their rows; a
document whose id is null takes part and never names a component unless no id is there; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED = 42


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """Unsigned SimHash of the word shingles of a text with A-Z in lower case; see the contract in the module."""
    import xxhash

    joined, first, ends = joined_words(text.encode("utf-8") if isinstance(text, str) else text or b"")
    if not len(first):
        return 0
    n = max(1, len(first) - words + 1)
    ends, bits = ends[min(words, len(first)) - 1 :], np.zeros(64, np.int64)
    for lo in range(0, n, 65536):  # bounded memory for very long texts
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[lo : min(n, lo + 65536)].tolist(), ends[lo : lo + 65536].tolist())]
        bits += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def joined_words(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text in lower case with one space between them, and where each begins and ends; a few bytes of memory a byte."""
    data = np.frombuffer(raw.lower(), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    after = np.append(True, blank[:-1])  # a blank, or the beginning, stands before
    kept = np.flatnonzero(~blank | ~after)
    joined = np.where(blank[kept], 32, data[kept]).astype(np.uint8)
    if len(joined) and joined[-1] == 32:
        joined = joined[:-1]
    space = np.flatnonzero(joined == 32)
    if not len(joined):
        return b"", space, space
    return joined.tobytes(), np.append(0, space + 1), np.append(space, len(joined))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    common.ship(docs.sparkSession)
    # As bytes, which need not be valid.
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache
def index_sets(matches: int, size: int = 4) -> tuple[tuple[int, ...], ...]:
    """Sets of byte positions such that any ``matches`` of the eight positions hold one of them (greedy cover)."""
    size = min(size, matches)
    open_sets = {frozenset(c) for c in combinations(range(8), matches)}
    chosen = []
    while open_sets:
        count = Counter(s for o in open_sets for s in combinations(sorted(o), size))
        best = max(sorted(count), key=count.get)
        chosen.append(best)
        open_sets = {o for o in open_sets if not o >= set(best)}
    return tuple(chosen)


def _near(one: np.ndarray, many: np.ndarray, matches: int, max_bits: int) -> np.ndarray:
    """Count filter and verification of fingerprints against others (broadcast)."""
    diff = np.atleast_1d(one ^ many)
    shared = (diff.view(np.uint8).reshape(*diff.shape, 8) == 0).sum(-1)
    return (shared >= matches) & (np.bitwise_count(diff.view(np.uint64)) <= max_bits)  # of signed numbers it counts the absolute value


def spanning_links(fp: np.ndarray, rep: np.ndarray, matches: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the connected parts of one posting list."""
    links, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _near(fp[at], fp[left], matches, max_bits)
            links += [(int(rep[at]), int(rep[k])) for k in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return links


def list_links(fp: np.ndarray, rep: np.ndarray, matches: int, max_bits: int, most: int = 4096) -> list[tuple[int, int]]:
    """:func:`spanning_links`; in a long list, pairs share one more byte than all of the list do, and are looked for under it."""
    if len(fp) <= most:
        return spanning_links(fp, rep, matches, max_bits)
    parts = fp.view(np.uint8).reshape(-1, 8)
    free = [p for p in range(8) if (parts[:, p] != parts[0, p]).any()]
    if 8 - len(free) >= matches:  # all share enough already
        return spanning_links(fp, rep, matches, max_bits)
    out = []
    for p in free:
        order = np.argsort(parts[:, p], kind="stable")
        bounds = np.flatnonzero(np.diff(parts[order, p])) + 1
        for at in np.split(order, bounds):
            out += list_links(fp[at], rep[at], matches, max_bits, most)
    return out


def _lists(batches):
    """Whole posting lists (arrays of fp, rep) from batches that are sorted by list."""
    rest = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
        last = new[-1] if len(new) else 0
        yield [x[:last] for x in now], new
        rest = [x[last:] for x in now]
    if rest is not None:
        yield rest, np.array([len(rest[0])])


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """``u, v``: links between nodes (``fp``, ``rep``: distinct fingerprints and an id of each) that connect whatever
    pairs within ``max_bits`` bits connect."""
    matches = 8 - max_bits
    sets = index_sets(matches)

    def key(s):
        out = F.lit(0).cast("long")
        for p in s:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        return out

    index = nodes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), key(s).alias("key")) for i, s in enumerate(sets)])).alias("at"))
    index = index.select("at.part", "at.key", "fp", "rep").repartition("part", "key").sortWithinPartitions("part", "key")

    def run(batches):
        for (_, _, fp, rep), new in _lists(batches):
            if not len(fp):
                continue
            bounds = np.concatenate([[0], new[new < len(fp)], [len(fp)]])
            sizes = np.diff(bounds)
            pairs = []
            two = bounds[:-1][sizes == 2]
            ok = _near(fp[two], fp[two + 1], matches, max_bits) if len(two) else np.zeros(0, bool)
            pairs += list(zip(rep[two[ok]].tolist(), rep[two[ok] + 1].tolist(), strict=True))
            for a, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                pairs += list_links(np.ascontiguousarray(fp[a : a + n]), rep[a : a + n], matches, max_bits)
            if pairs:
                u, v = zip(*set(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    common.ship(nodes.sparkSession)
    return index.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every document."""
    fps = common.written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    parts = connected_components(links(nodes.where("rep is not null"), max_bits))
    of = nodes.join(parts, nodes["rep"] == parts["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, fps["fp"] == of["_fp"]).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group."""
    groups = simhash_groups(docs, words, max_bits, id_col, text_col)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
