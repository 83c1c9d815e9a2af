"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id goes. A string is
dealt by the smallest of the short seeds inside it: neighbouring strings mostly share that seed, so they travel together
as one *stretch* of text, and equal strings meet in the same bucket wherever they stand. Seeds are ordered by how frequent
their kind is in a bounded sample (rarer first), then by hash, so that a frequent seed is chosen only where a string has no
other; the order balances buckets and has no influence on results. Stretches that are equal, byte for byte, within
one batch are settled there, so that a bucket receives a common passage once a batch however many documents hold it.
A batch sends one compressed piece to each bucket. A bucket over ``MOST_BYTES`` is not held: its stretches are cut again by longer
seeds and dealt anew in another round, at last by the whole string.

A bucket is settled in groups of about ``GROUP_BYTES``, by other bits of the seed's hash. In a group, equal stretches are settled
first. Strings whose hash no other string of the group has are left out; the suffixes that start all others are sorted by a
bottom-up mergesort: two suffixes are compared by their longest common extension, found by binary search over prefix
polynomial hashes, and the byte after it. Neighbours in that order that agree for ``length`` bytes, by their extension and byte
by byte, form runs (if a collision shows, the bytes themselves are sorted), and each run's smallest document keeps its bytes.

Positions are bytes of the text's UTF-8 as it is stored, valid or not. A null text is empty; texts shorter than ``length`` lose nothing;
rows that share an id never remove from one another; rows without an id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BATCH_BYTES, BUCKET_BYTES, MOST_BYTES, GROUP_BYTES, PIECE_BYTES, LEVEL = 16_000_000, 16_000_000, 64_000_000, 1_000_000, 1_000_000, 6
#: Bytes of the seeds by round; the last round's seeds are the whole strings.
SEEDS = (8, 24, 40)
#: Kinds of seeds that are counted, and bytes of text in the sample that counts them.
SLOTS, SAMPLE_BYTES = 1 << 16, 8_000_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)

_TABLES: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers; one table of each base is kept, as long as the longest asked for."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _TABLES[base] = have
    return have


class Prefix:
    """Prefix polynomial hashes of a byte array, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        size = -(-(len(data) + 1) // 1_000_000) * 1_000_000 if len(data) > 1 << 16 else 1 << 16
        self.inverse = _powers(size, INVERSE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        self.sums[1:] = data
        self.sums[1:] += np.uint64(1)
        self.sums[1:] *= _powers(size, BASE)[: len(data)]
        np.cumsum(self.sums, out=self.sums)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all strings of that length."""
        n = len(self.data) - length + 1
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def seed_order(prefix: Prefix, seed: int, ranks: np.ndarray | None) -> np.ndarray:
    """A number for every seed that orders seeds: by the rank of its kind, then by hash."""
    h = _mixed(prefix.every(seed))
    if ranks is not None:
        rank = ranks[h >> np.uint64(48)]
        h >>= np.uint64(4)
        h |= rank
    return h


def stretches(data: np.ndarray, ends: np.ndarray, length: int, seed: int, ranks: np.ndarray | None = None):
    """Text, start in ``data``, byte count, smallest seed and own hash of the stretches of texts that stand end to end
    (``ends``: where each ends)."""
    got = []
    for lo in range(0, len(data) - length + 1, PIECE_BYTES):
        piece = data[lo : lo + PIECE_BYTES + length - 1]
        prefix = Prefix(piece)
        m = _smallest(seed_order(prefix, seed, ranks), length - seed + 1)
        # Strings that lie in one text.
        text = np.searchsorted(ends, lo, "right")
        inner = ends[text : np.searchsorted(ends, lo + len(m) + length - 1, "left")] - lo
        within, new = np.ones(len(m) + 1, bool), np.ones(len(m), bool)
        within[-1] = False
        new[1:] = m[1:] != m[:-1]
        for e in inner.tolist():
            within[max(0, e - length + 1) : e] = False
            if e < len(new):
                new[e] = True
        new &= within[:-1]
        first = np.flatnonzero(new)
        # A stretch ends before the next one, or where strings leave their text.
        out = np.flatnonzero(~within)
        stop = np.minimum(np.append(first[1:], len(m)), out[np.searchsorted(out, first)])
        size = stop - first + length - 1
        got.append((np.searchsorted(ends, lo + first, "right"), lo + first, size, m[first], prefix.of(first, size)))
    if not got:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ragged slices, end to end."""
    out, at = np.empty(int(size.sum()), np.uint8), 0
    for lo in range(0, len(start), 5_000):
        a, n = start[lo : lo + 5_000], size[lo : lo + 5_000]
        total = np.cumsum(n)
        out[at : at + total[-1]] = data[np.arange(total[-1]) + np.repeat(a - (total - n), n)]
        at += int(total[-1])
    return out


def settle_equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, whole: np.ndarray):
    """Of stretches with equal bytes, those of the smallest document (``first``) and those of others (``gone``), as masks.
    Equality is checked byte for byte against the first; what only collides in the hash stays first."""
    h = whole ^ (size.astype(np.uint64) << np.uint64(40))
    order = np.lexsort((doc, h))
    head = np.ones(len(order), bool)
    head[1:] = h[order[1:]] != h[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    gone = np.zeros(len(start), bool)
    gone[order] = doc[order] > doc[lead]
    of = np.empty(len(start), np.int64)
    of[order] = lead
    at = np.flatnonzero(gone)
    gone[at] &= size[at] == size[of[at]]
    at = np.flatnonzero(gone)
    for lo in range(0, len(at), 5_000):
        part = at[lo : lo + 5_000]
        same = _gather(data, start[part], size[part]) == _gather(data, start[of[part]], size[part])
        ends = np.cumsum(size[part])
        gone[part] = np.logical_and.reduceat(same, ends - size[part])
    return ~gone, gone


def _extension(prefix: Prefix, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Longest common extension from ``x`` and ``y``, up to ``length``: binary search over prefix hashes."""
    low, step = np.zeros(len(x), np.int64), 1 << (length.bit_length() - 1)
    whole = prefix.of(x, length) == prefix.of(y, length)
    low[whole] = length
    open_ = np.flatnonzero(~whole)
    while step and len(open_):
        to = low[open_] + step
        can = open_[to <= length]
        to = low[can] + step
        same = prefix.of(x[can], to) == prefix.of(y[can], to)
        low[can[same]] = to[same]
        step >>= 1
    return low


def _less(prefix: Prefix, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Is the suffix at ``x`` smaller than that at ``y`` in the first ``length`` bytes?"""
    n = np.minimum(_extension(prefix, x, y, length), length - 1)  # a whole match compares its last, equal, byte
    return prefix.data[x + n] < prefix.data[y + n]


def suffix_sort(prefix: Prefix, at: np.ndarray, length: int) -> np.ndarray:
    """``at`` in the order of the first ``length`` bytes of the suffixes there: sorted by the first eight bytes at once, then, among suffixes
    that share these, by a bottom-up mergesort in which all runs of a level are merged by ranks."""
    head = np.zeros(len(at), np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | prefix.data[at + k]
    order = np.argsort(head, kind="stable")
    at, head = at[order], head[order]
    new = np.ones(len(at), bool)
    new[1:] = head[1:] != head[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    several = np.repeat(sizes > 1, sizes)
    base, size = np.repeat(first, sizes)[several], np.repeat(sizes, sizes)[several]
    where = np.flatnonzero(several)
    run = 1
    while len(where):
        place = where - base
        block, inside = place // (2 * run), place % (2 * run)
        left = inside < run
        start = base + block * 2 * run
        other = start + np.where(left, run, 0)  # start of the run to be ranked in
        lo, hi = np.zeros(len(where), np.int64), np.clip(base + size - other, 0, run)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            there, mine = other[open_] + mid, where[open_]
            # A left element goes before its equals on the right, a right element after its equals on the left.
            a, b = np.where(left[open_], there, mine), np.where(left[open_], mine, there)
            before = _less(prefix, at[a], at[b], length) == left[open_]
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        moved = at.copy()
        moved[start + np.where(left, inside, inside - run) + lo] = at[where]
        at, run = moved, 2 * run
        still = size > run
        where, base, size = where[still], base[still], size[still]
    return at


def repeated(prefix: Prefix, start: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int):
    """Stretch and offset of every string of ``length`` bytes that a smaller document has too."""
    n = size - length + 1
    base = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(start - base, n)
    # A string whose hash no string of another document has repeats nothing.
    h = _mixed(prefix.of(at, length))
    slot = (h >> np.uint64(62 - len(h).bit_length())).astype(np.int64)
    some = np.flatnonzero((np.bincount(slot) > 1)[slot])
    if not len(some):
        return some, some
    order = some[np.argsort(h[some], kind="stable")]
    bounds = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
    docs = doc[np.searchsorted(start, at[order], "right") - 1]
    shared = np.minimum.reduceat(docs, bounds) < np.maximum.reduceat(docs, bounds)
    some = np.sort(order[np.repeat(shared, np.diff(np.append(bounds, len(order))))])
    if not len(some):
        return some, some
    ranked = suffix_sort(prefix, at[some], length)
    of = np.searchsorted(start, ranked, "right") - 1
    # Neighbours in the order that agree to the end are one run.
    same = _extension(prefix, ranked[1:], ranked[:-1], length) == length
    windows = np.lib.stride_tricks.sliding_window_view(prefix.data, length)
    pairs = np.flatnonzero(same)
    if all((windows[ranked[pairs[lo : lo + 20_000]]] == windows[ranked[pairs[lo : lo + 20_000] + 1]]).all() for lo in range(0, len(pairs), 20_000)):
        heads = np.flatnonzero(np.append(True, ~same))
    else:  # a collision: sort by the bytes
        kind = np.unique(windows[ranked], axis=0, return_inverse=True)[1].ravel()
        turn = np.argsort(kind, kind="stable")
        ranked, of = ranked[turn], of[turn]
        heads = np.flatnonzero(np.append(True, np.diff(kind[turn]) != 0))
    docs = doc[of]
    out = docs > np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(docs))))
    return of[out], ranked[out] - start[of[out]]


def _seed(level: int, length: int) -> int:
    return min((*SEEDS, length)[level], length)


def _by_kind(kind: np.ndarray):
    """Each kind (0 or more) with the places where it is."""
    order = np.argsort(kind, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(kind[order], prepend=-1)), len(order))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(kind[order[a]]), order[a:b]


def _kind(least: np.ndarray) -> np.ndarray:
    """Other bits of the smallest seeds than those that choose a bucket."""
    return (_mixed(least ^ np.uint64(77)) >> np.uint64(48)).astype(np.uint16)


class Stretches:
    """Stretches with their bytes: document id, mark of its text, start there, byte count and kind of the smallest seed."""

    def __init__(self, ids, marks, start, size, kind, data):
        self.ids, self.marks, self.start, self.size, self.kind, self.data = ids, marks, start, size, kind, data

    def packed(self) -> bytes:
        return _pack(np.diff(self.ids, prepend=0), self.marks, np.diff(self.start, prepend=0).astype(np.int32), self.size.astype(np.int32), self.kind, self.data)

    @staticmethod
    def unpacked(blob: bytes) -> Stretches:
        ids, marks, start, size, kind, data = _unpack(blob, np.int64, np.int64, np.int32, np.int32, np.uint16, np.uint8)
        return Stretches(np.cumsum(ids), marks, np.cumsum(start, dtype=np.int64), size.astype(np.int64), kind, data)

    @staticmethod
    def joined(parts: list[Stretches]) -> Stretches:
        return Stretches(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "marks", "start", "size", "kind", "data")))

    def base(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def parts(self, kind: np.ndarray):
        """The stretches of each kind, with the kind."""
        base = self.base()
        for k, at in _by_kind(kind):
            yield k, Stretches(self.ids[at], self.marks[at], self.start[at], self.size[at], self.kind[at], _gather(self.data, base[at], self.size[at]))

    def cut(self, length: int, seed: int) -> tuple[Stretches, np.ndarray]:
        """The same strings in stretches by longer seeds, and the smallest seeds."""
        of, at, size, least, _ = stretches(self.data, np.cumsum(self.size), length, seed)
        return Stretches(self.ids[of], self.marks[of], self.start[of] + at - self.base()[of], size, _kind(least), _gather(self.data, at, size)), least


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(np.ascontiguousarray(a).data for a in arrays))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(raw, np.int64, len(types)), types, strict=True):
        out.append(np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, at))
        at += int(n)
    return out


def _runs_of(positions: np.ndarray, owner: np.ndarray):
    """First and last of each run of consecutive positions of one owner (sorted)."""
    new = np.ones(len(positions), bool)
    new[1:] = (positions[1:] != positions[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(positions)) - 1


def settle(have: Stretches, length: int, level: int):
    """Yields ``ids, marks, start, stop`` of the strings to remove among these stretches, which hold all equals of their strings."""
    groups = max(1, -(-len(have.data) // GROUP_BYTES))
    for _, part in have.parts(have.kind.astype(np.int64) % groups):
        if len(part.data) > 3 * GROUP_BYTES and level < len(SEEDS):  # a frequent seed
            yield from settle(part.cut(length, _seed(level + 1, length))[0], length, level + 1)
        else:
            yield from _settle_group(part, length)


def _settle_group(have: Stretches, length: int):
    prefix, base = Prefix(have.data), have.base()
    stay, gone = settle_equal(have.data, base, have.size, have.ids, prefix.of(base, have.size))
    yield have.ids[gone], have.marks[gone], have.start[gone], (have.start + have.size)[gone]
    k = np.flatnonzero(stay)
    of, offset = repeated(prefix, base[k], have.size[k], have.ids[k], length)
    if len(of):
        order = np.lexsort((offset, of))
        of, offset = k[of[order]], offset[order]
        first, last = _runs_of(offset, of)
        yield have.ids[of[first]], have.marks[of[first]], have.start[of[first]] + offset[first], have.start[of[last]] + offset[last] + length


#: Rows of a round: stretches for a bucket (``blob``), or a span to remove.
ROUND = "bucket long, blob binary, doc_id long, mark long, start long, stop long"


def _rows(bucket=None, blob=None, spans=None):
    n = len(bucket) if spans is None else len(spans[0])
    columns = [pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())] if spans is None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    columns += [pa.nulls(n, pa.int64())] * 4 if spans is None else [pa.array(x, pa.int64()) for x in spans]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "blob", "doc_id", "mark", "start", "stop"])


def _bucket(least: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(least) % np.uint64(buckets)).astype(np.int64)


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes end to end and byte counts of a binary column without nulls."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def seed_ranks(docs: DataFrame, length: int, total: int) -> np.ndarray:
    """A rank for each kind of seed, in the upper four bits: how often it is in a sample of about ``SAMPLE_BYTES``, as a power of two
    of the mean. ``docs`` has doc_id and text (binary)."""
    share = int(min(1.0, SAMPLE_BYTES / max(total, 1)) * 1_000_000)

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            data = _texts(b.column(0))[0]
            for lo in range(0, len(data) - SEEDS[0] + 1, PIECE_BYTES):
                piece = data[lo : lo + PIECE_BYTES + SEEDS[0] - 1]
                n += np.bincount((_mixed(Prefix(piece).every(SEEDS[0])) >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share).select("text")
    got = some.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most SLOTS rows
    n = np.ones(SLOTS)
    for r in got:
        n[r.slot] = r.n
    return np.clip(np.floor(np.log2(np.maximum(n / n.mean(), 1))), 0, 15).astype(np.uint64) << np.uint64(60)


def _dealt(docs: DataFrame, length: int, buckets: int, ranks: np.ndarray) -> DataFrame:
    """The first round's rows; ``docs`` has mark, doc_id and text (binary)."""
    seed = _seed(0, length)

    def emit(held):
        """One batch of documents."""
        ids, marks, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum(sizes)
        of, at, size, least, whole = stretches(data, ends, length, seed, ranks)
        if not len(of):
            return
        start = at - (ends - sizes)[of]
        stay, gone = settle_equal(data, at, size, ids[of], whole)
        g = np.flatnonzero(gone)
        if len(g):  # neighbouring stretches overlap: one span
            new = np.append(True, (of[g[1:]] != of[g[:-1]]) | (start[g[1:]] > (start + size)[g[:-1]]))
            last = np.append(np.flatnonzero(new)[1:] - 1, len(g) - 1)
            yield _rows(spans=(ids[of[g[new]]], marks[of[g[new]]], start[g[new]], (start + size)[g[last]]))
        k, kind = np.flatnonzero(stay), _kind(least)
        for bucket, j in _by_kind(_bucket(least[k], buckets)):
            j = k[j]
            yield _rows([bucket], [Stretches(ids[of[j]], marks[of[j]], start[j], size[j], kind[j], _gather(data, at[j], size[j])).packed()])

    def run(batches):
        held, room = [], BATCH_BYTES
        for b in batches:
            marks, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, sizes = _texts(b.column(2))
            ends, lo = np.cumsum(sizes), 0
            while lo < len(ids):
                done = int(ends[lo] - sizes[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, done + room, "right")))
                held.append((ids[lo:hi], marks[lo:hi], sizes[lo:hi], data[done : int(ends[hi - 1])]))
                room -= int(ends[hi - 1]) - done
                lo = hi
                if room <= 0 or hi < len(ids):
                    yield from emit(held)
                    held, room = [], BATCH_BYTES
        if held:
            yield from emit(held)

    return docs.mapInArrow(run, ROUND)


def _settled(dealt: DataFrame, length: int, level: int, buckets: int, most: int) -> DataFrame:
    """Settles the buckets of a round; a bucket that is too large for a task is dealt anew, for the next one. Spans pass."""

    def run(batches):
        now, held, size = None, [], 0

        def whole():
            for found in settle(Stretches.joined(held), length, level):
                if len(found[0]):
                    yield _rows(spans=found)

        for b in batches:
            bucket_, blobs = b.column(0).to_pylist(), b.column(1)
            spans = b.filter(blobs.is_null())
            if spans.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(spans.num_rows, pa.int64()), *spans.columns[1:]], b.schema.names)
            for i, bucket in enumerate(bucket_):
                if not blobs[i].is_valid:
                    continue
                if bucket != now:
                    if held:
                        yield from whole()
                    now, held, size = bucket, [], 0
                part = Stretches.unpacked(blobs[i].as_py())
                size += len(part.data)
                held.append(part)
                if size > most and level < len(SEEDS):
                    for p in held:
                        again, least = p.cut(length, _seed(level + 1, length))
                        for to, piece in again.parts(_bucket(least, buckets)):
                            yield _rows([to], [piece.packed()])
                    held = []
        if held:
            yield from whole()

    key = F.coalesce("bucket", F.pmod("doc_id", F.lit(buckets)))
    return dealt.withColumn("bucket", key).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ROUND)


def repeated_spans(docs: DataFrame, length: int = 50, buckets: int | None = None, most: int = MOST_BYTES) -> DataFrame:
    """``doc_id, mark, start, stop``: spans (of bytes, overlapping) to remove; ``docs`` has mark, doc_id and text (binary), ids not null."""
    long = docs.where(F.octet_length("text") >= length).select("mark", "doc_id", "text")
    total = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(64, int(total * 3.3) // BUCKET_BYTES)
    common.ship(docs.sparkSession)
    dealt, spans = _dealt(long, length, buckets, seed_ranks(long, length, total)), None
    for level in range(len(SEEDS) + 1):
        round_ = common.written(_settled(dealt, length, level, buckets, most), "spans")
        found = round_.where("blob is null").select("doc_id", "mark", "start", "stop")
        spans = found if spans is None else spans.union(found)
        dealt = round_.where("blob is not null")
        if dealt.isEmpty():
            break
    return spans


def remove_repeats(docs: DataFrame, length: int = 50, buckets: int | None = None, most: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept (binary), n_bytes, n_removed, n_spans``: every document with its repeats removed."""
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Only where ids repeat does a mark of the text tell the rows apart.
    several = not base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    base = base.withColumn("mark", F.xxhash64("text") if several else F.lit(0).cast("long"))
    spans = repeated_spans(base.where("doc_id is not null"), length, buckets, most)
    ends = spans.groupBy("doc_id", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def press(batches):  # texts travel compressed
        for b in batches:
            pressed = [zstandard.ZstdCompressor(level=3).compress(t.as_buffer()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pressed, pa.binary())], ["doc_id", "mark", "packed"])

    texts = base.select("doc_id", "mark", "text").mapInArrow(press, "doc_id long, mark long, packed binary")

    def cut(batches):
        for b in batches:
            kept, size, removed, n = [], [], [], []
            for t, starts, stops in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = zstandard.ZstdDecompressor().decompress(t)
                size.append(len(data))
                if not starts:
                    kept.append(data)
                    removed.append(0)
                    n.append(0)
                    continue
                s = np.sort(np.array(starts))
                e = np.maximum.accumulate(np.array(stops)[np.argsort(np.array(starts), kind="stable")])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                n.append(len(s))
                removed.append(int((e - s).sum()))
                cuts = np.append(s, len(data)).tolist()
                kept.append(b"".join(data[x:y] for x, y in zip([0, *e.tolist()], cuts, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, n))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return texts.join(ends, ["doc_id", "mark"], "left").select("doc_id", "packed", "starts", "stops").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
