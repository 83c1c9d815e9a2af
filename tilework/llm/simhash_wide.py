"""Groups of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, tested exactly.

SimHash comes first, as in :mod:`.simhash`: a fingerprint of 64 bits a shingle set, the inverted index of positional bytes with its
count filter, and what is within ``BITS`` bits is nominated, compared by all shingles and linked. That guarantees pairs by bits and not by
similarity: at 0.8 some 10 of 64 bits differ (39 of 256, of whose bytes 96 lists of three miss a third of the pairs). So the pairs
that the links so far do not connect are looked for in a second index, whose guarantee is by similarity. The smallest values of
``BANDS * ROWS`` mixes of the shingles' hashes are each shared by two documents with a chance equal to their similarity; this index
lists documents under each band of ``ROWS`` values, and a pair at 0.8 misses all lists with a chance of (1 - 0.8 ** 4) ** 20 = 2.7e-5.
The positional bytes deal the hashes out to ``BINS`` bins by their leading bits and keep a byte of the smallest of each bin. The smallest
of the bins that one of two documents fills are a sample of all their shingles without replacement, so the number of equal bytes is
hypergeometric at least, and its variance vanishes as the bins reach the number of shingles: pairs well below 0.8 are told apart where they
meet. A pair that meets is tallied over the first ``COARSE`` bins and then over all, and left if a count is ``SLACK`` standard deviations
below that of a pair at 0.8 (a chance under 1e-5, see the tests), or if the numbers of shingles rule 0.8 out. The rest is
compared by the 64-bit hashes of all their shingles, made once for each text, and only those at 0.8 or more are linked.

Documents of equal shingle sets are one node. The pairs of a list are compared in rounds of growing distance within the
list, and pairs that verified links connect already are left out, so that a group of near copies costs about as many
comparisons as it has members and not their pairs; all links together connect what all pairs that meet would connect.

Defined results are those of :mod:`.simhash`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import SEED, joined_words, links

WORDS, BITS, BANDS, ROWS = 5, 3, 20, 4
BINS, COARSE, SLACK = 512, 128, 5.0
#: Node keys are sent to every task only up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
_DRAWS = np.random.default_rng(19).integers(0, 2**64, (2, BANDS * ROWS), np.uint64, endpoint=False)
FACTORS, SHIFTS = _DRAWS[0] | np.uint64(1), _DRAWS[1]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the distinct word shingles (A-Z in lower case), in order; a shorter text is one shingle, and one without a word has none."""
    import xxhash

    joined, first, ends = joined_words((text or "").encode("utf-8"))
    n = max(1, len(first) - words + 1) if len(first) else 0
    ends, parts = ends[min(words, len(first)) - 1 :], [np.zeros(0, np.uint64)]
    for lo in range(0, n, 65536):  # bounded memory for very long texts
        at = zip(first[lo : min(n, lo + 65536)].tolist(), ends[lo : lo + 65536].tolist())
        parts.append(np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in at], np.uint64)))
    return np.unique(np.concatenate(parts))


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """A Jaccard similarity of 0.8 or more of two arrays of :func:`shingle_hashes`, in whole numbers."""
    if len(one) > len(other):
        one, other = other, one
    if not len(one):
        return not len(other)
    both = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return 5 * both >= 4 * (len(one) + len(other) - both)


def majority_bits(hashes: np.ndarray) -> int:
    """SimHash as a signed number: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray, np.ndarray, int, int]:
    """A key of the shingle set, the smallest value of each mix (none without a word), the positional bytes, the number of shingles, and their SimHash."""
    import xxhash

    hashes = shingle_hashes(text, words)
    key = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):  # bounded memory for very long texts
        h = hashes[lo : lo + 4096, None] * FACTORS + SHIFTS
        h ^= h >> np.uint64(32)
        least = np.minimum(least, (h * FACTORS[::-1]).min(0))
    return key, least if len(hashes) else least[:0], binned(hashes), len(hashes), majority_bits(hashes)


def binned(hashes: np.ndarray) -> np.ndarray:
    """A byte from 1 of the smallest hash of each bin, 0 where a bin is empty."""
    first = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS))
    full = first < np.append(first[1:], len(hashes))
    out = np.zeros(BINS, np.uint8)
    out[full] = hashes[first[full]] % np.uint64(255) + np.uint64(1)
    return out


def least_equal(filled: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many equal bytes a pair at 0.8 has at least, ``filled`` bins of it holding something and ``size`` being the sum of its numbers of shingles."""
    union = np.maximum(2, size / 1.8)
    return 0.8 * filled - SLACK * np.sqrt(0.16 * filled * np.clip((union - filled) / (union - 1), 0, 1)) - 0.5


def likely(one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows of positional bytes may be of pairs at 0.8."""
    return ((one == other) & (one > 0)).sum(1) >= least_equal(((one | other) > 0).sum(1), size)


def bands(least: np.ndarray) -> np.ndarray:
    """The key of each list."""
    key = np.arange(BANDS if len(least) else 0, dtype=np.uint64)
    for part in least.reshape(-1, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _printed(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            prints = [fingerprint(t.as_py(), words) for t in b.column(1)]
            keys = pa.array([bands(x).tolist() for _, x, *_ in prints], pa.list_(pa.int64()))
            sketch = pa.array([x.tobytes() for _, _, x, *_ in prints], pa.binary())
            node, size, fp = (pa.array([x[i] for x in prints], pa.int64()) for i in (0, 3, 4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, size, fp, keys, sketch], ["doc_id", "text", "node", "size", "fp", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, text string, node long, size long, fp long, bands array<long>, sketch binary")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, hashes``: the shingles of each text (``node, text``)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def within_bits(nodes: DataFrame) -> DataFrame:
    """``u, v``: pairs of nodes (``node, size, fp``) that connect whatever SimHashes within ``BITS`` bits connect: the links of
    :func:`.simhash.links`, and a chain through the nodes of one SimHash. Nodes without a shingle are left out."""
    some = nodes.where("size > 0").select("node", "fp")
    before = F.lag("node").over(Window.partitionBy("fp").orderBy("node"))
    same = some.select(before.alias("u"), F.col("node").alias("v")).where("u is not null")
    near = links(some.groupBy("fp").agg(F.min("node").alias("rep")), BITS)
    return same.union(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()


def _nominated(lists: DataFrame, low: int, high: int) -> DataFrame:
    """``u, v``: pairs of one list (``key, node, part, size, sketch``) at a distance from ``low`` to below ``high``, unless of one part.
    No more than ``high`` rows are kept at a time."""

    def run(batches):
        tail = None
        for b in batches:
            now = [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)), np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, BINS)]
            old = 0 if tail is None else len(tail[0])
            key, node, part, size, sketch = now if tail is None else [np.concatenate(x) for x in zip(tail, now, strict=True)]
            for d in range(low, min(high, len(key))):
                i = np.arange(max(d, old), len(key))
                i = i[(key[i] == key[i - d]) & (part[i] != part[i - d])]
                i = i[5 * np.minimum(size[i], size[i - d]) >= 4 * np.maximum(size[i], size[i - d])]
                for k in range(0, len(i), 4096):
                    j = i[k : k + 4096]
                    for part_of in (slice(COARSE), slice(None)):
                        j = j[likely(sketch[j, part_of], sketch[j - d, part_of], size[j] + size[j - d])]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[j], node[j - d])), pa.array(np.maximum(node[j], node[j - d]))], ["u", "v"])
            keep = max(0, len(key) - high + 1)
            tail = [x[keep:].copy() for x in (key, node, part, size, sketch)]

    return lists.select("key", "node", "part", "size", "sketch").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingles are similar."""

    def run(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _parts(prints: DataFrame, words: int) -> DataFrame | None:
    """``node, component`` of the nodes that have a similar one (none: nothing is similar). What SimHash connects comes first."""
    at = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    at = common.written(at, "wide-nodes")
    nominated = common.written(within_bits(at), "wide-simhash")
    posted = at.select("node", F.posexplode("bands").alias("band", "key"))
    lists = posted.join(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    lists = common.written(lists, "wide-lists")
    wanted = common.written(lists.select("node").union(nominated.select(F.explode(F.array("u", "v")))).distinct(), "wide-wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    sets = common.written(_sets(prints.join(side, "node").groupBy("node").agg(F.first("text").alias("text")), words), "wide-sets", "none")
    found, parts, low, high = common.written(_verified(nominated, sets), "wide-links"), None, 1, 2
    if found.isEmpty():
        found = None
    else:
        parts = common.written(connected_components(found), "wide-parts")
    # Neighbours of one list come first, then those of more lists: most of a group is connected before its other lists are read.
    turns = [1, 4, BANDS]
    while True:
        open_lists = lists.where((F.col("n") > low) & (F.col("band") < turns[0]))
        if parts is None:
            open_lists = open_lists.withColumn("part", F.col("node"))
        else:
            open_lists = open_lists.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
            mixed = open_lists.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one < other").select("key")
            open_lists = open_lists.join(mixed, "key")
        open_lists = open_lists.select("key", "node", "part").join(at.select("node", "size", "sketch"), "node")
        open_lists = common.written(open_lists.select("key", "node", "part", "size", "sketch"), "wide-open", "none")
        if open_lists.isEmpty():
            if len(turns) == 1:
                return parts
            turns.pop(0)
            continue
        new = common.written(_verified(_nominated(open_lists, low, high), sets), "wide-links")
        common.forget(open_lists)
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            parts = common.written(connected_components(found), "wide-parts")
        if len(turns) > 1:
            turns.pop(0)
        else:
            low, high = high, 8 * high


def near_copy_groups(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every document."""
    common.ship(docs.sparkSession)
    prints = common.written(_printed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), words), "wide-fingerprints")
    parts = _parts(prints, words)
    of = prints.select("doc_id", "node").withColumn("part", F.col("node"))
    if parts is not None:
        of = prints.select("doc_id", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    names = of.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return of.join(names, "part").select("doc_id", "component_id")


def near_copy_dedup(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group."""
    groups = near_copy_groups(docs, words, id_col, text_col)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
