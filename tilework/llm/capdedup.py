"""Near-duplicate embeddings by spherical-cap filters made of structured random product codes.

A vector's dimensions fall into four blocks, each with a seeded book of random unit vectors; a filter direction is one
word of every block. List decoding enumerates all filters whose cap a vector lies in (its inner product with the
direction exceeds a threshold) from sorted sums of half codes, without visiting the others. A vector's best four filters
are its homes, and every vector lying in a home's cap is a member there. Two vectors of a label meet where one has
a home and the other is a member, and are verified by their cosine in double precision.

A pair that meets at several homes is counted at the smallest of them, which is told from both vectors' block products,
so links are counted without listing pairs. For components, a meeting yields links that span its connected parts.
A home with many members is dealt in blocks, so that a group of near copies spreads over tasks. Equal vectors
of a label are one node with a weight.

Vectors that are null, zero or hold null or non-finite components, and rows whose label is null, link with nothing and
keep their row; vectors of different lengths do not link; repeated rows link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ann import _matrix, _runs
from .components import connected_components

BLOCKS, HOMES, SEED, DEALT = 4, 4, 11, 128
#: Filters that a vector lies in on average at 16 words a block; with them, 97 % of pairs at a cosine of 0.93 meet, the worst of all
#: that link. The same share at more words takes more filters, in proportion to this power of the words (0.2 of the vectors).
FILTERS, FILTERS_AT, GROWTH, SAMPLE = 320, 16, 0.85, 24
FAR = np.iinfo(np.int64).max


class CapCode:
    """The filters for vectors of ``d`` components: ``words`` per block and block books; see the module docstring."""

    def __init__(self, d: int, words: int, seed: int = SEED):
        self.words, self.parts = words, np.array_split(np.arange(d), min(BLOCKS, d))
        self.half = max(1, len(self.parts) // 2)
        rng = np.random.default_rng([seed, d, words])
        self.books = []
        for p in self.parts:
            w = rng.standard_normal((words, len(p)))
            self.books.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(self.parts)))
        self.threshold = self._calibrated(rng.standard_normal((SAMPLE, d)), FILTERS * (words / FILTERS_AT) ** GROWTH)

    def _calibrated(self, x: np.ndarray, filters: float) -> float:
        """The threshold at which the sampled directions lie in so many caps on average."""
        halves = [self._halves(p) for p in self.products(x / np.linalg.norm(x, axis=1, keepdims=True))]
        halves = [(left, np.sort(-right)) for left, right in halves]
        low, high = 0.0, 1.0
        for _ in range(14):
            middle = (low + high) / 2
            many = np.mean([np.searchsorted(right, left - middle, side="right").sum() for left, right in halves])
            low, high = (middle, high) if many > filters else (low, middle)
        return low

    def products(self, x: np.ndarray) -> np.ndarray:
        """Block products of unit vectors: row, block, word. A row's products do not depend on the rows beside it."""
        return np.stack([np.einsum("nk,wk->nw", x[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1)

    def _halves(self, products: np.ndarray) -> list[np.ndarray]:
        """Sums over all words of the first and of the other blocks."""
        sums = []
        for blocks in (range(self.half), range(self.half, len(self.parts))):
            total = np.zeros(1)
            for b in blocks:
                total = (total[:, None] + products[b][None, :]).ravel()
            sums.append(total)
        return sums

    def inside(self, products: np.ndarray, homes: np.ndarray, filters: np.ndarray) -> np.ndarray:
        """Does each row lie in the caps of its own ``filters`` (row, filter), or have a home there? Sums as :meth:`decode` does."""
        words, rest = [], filters
        for _ in self.parts:
            words.insert(0, rest % self.words)
            rest = rest // self.words
        left, right = np.zeros(filters.shape), np.zeros(filters.shape)
        for b, w in enumerate(words):
            part = np.take_along_axis(products[:, b], w, 1)
            left, right = (left + part, right) if b < self.half else (left, right + part)
        return (-right <= left - self.threshold) | (filters[:, :, None] == homes[:, None, :]).any(-1)

    def decode(self, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Homes, best first, and all filters of one vector: half sums, the second half sorted, so that only hits are visited."""
        left, right = self._halves(products)
        order = np.argsort(-right)
        threshold = self.threshold
        while True:
            hits = np.searchsorted(-right[order], left - threshold, side="right")
            if hits.sum() >= min(HOMES, len(left) * len(right)):
                break
            threshold -= 0.02  # few caps: the homes are the best of those that nearly hold the vector
        at = np.repeat(np.arange(len(left)), hits)
        inner = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        found = at * len(right) + order[inner]
        score = left[at] + right[order[inner]]
        homes = found[np.lexsort((found, -score))[:HOMES]]
        held = -right[order[inner]] <= left[at] - self.threshold
        return homes, np.union1d(found[held], homes)


def _unit(vecs: list) -> np.ndarray:
    x = np.array(vecs, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(nodes: DataFrame, words: int) -> DataFrame:
    """``label, d, id, homes, filters``."""

    def run(batches):
        codes: dict[int, CapCode] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                label, ids, vecs = (c.to_pylist() for c in b.slice(lo, 500).columns)
                d = [len(v) for v in vecs]
                found = []
                for n, v in zip(d, vecs, strict=True):
                    code = codes[n] = codes.get(n) or CapCode(n, words)
                    found.append(code.decode(code.products(_unit([v]))[0]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (label, d, ids)] + [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)], ["label", "d", "id", "homes", "filters"])

    return nodes.select("label", "id", "vec").mapInArrow(run, "label long, d long, id long, homes array<long>, filters array<long>")


#: A block of a home's meetings.
PLACE = ["key", "label", "d", "filter", "part", "home_part"]


def _verify(words: int, cosine: float):
    """Meetings of one home and block: link counts and spanning links."""

    def run(batches):
        codes: dict[int, CapCode] = {}
        for r in _runs(batches):
            names = r.schema.names
            place = np.stack([r.column(names.index(c)).to_numpy() for c in PLACE])
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(place) != 0).any(0)) + 1, [r.num_rows]]).tolist()
            ids, own, at, size = (r.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("id", "is_home", "filter", "n"))
            vecs, homes = r.column(names.index("vec")), _matrix(r.column(names.index("homes")))
            counts: dict[int, int] = {}
            u, v = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                q, m = a + np.flatnonzero(own[a:b]), a + np.flatnonzero(~own[a:b])
                if not len(q) or not len(m):
                    continue
                x = _unit(_matrix(vecs.slice(a, b - a)))
                linked = (x[q - a] @ x[m - a].T >= cosine) & (ids[q][:, None] != ids[m])
                if not linked.any():
                    continue
                code = codes[x.shape[1]] = codes.get(x.shape[1]) or CapCode(x.shape[1], words)
                products, f = code.products(x), at[a]
                i, j = np.nonzero(linked)
                # All places where the pair meets: homes of either in whose cap the other lies.
                one, two = homes[q[i]], homes[m[j]]
                meets = np.hstack([np.where(code.inside(products[m[j] - a], two, one), one, FAR), np.where(code.inside(products[q[i] - a], one, two), two, FAR)])
                both = (two == f).any(1)  # here each is a home and a member
                mine = np.zeros(linked.shape, np.int64)
                mine[i, j] = (meets.min(1) == f) & (~both | (ids[q[i]] < ids[m[j]]))
                for i, n in zip(ids[q], mine @ size[m], strict=True):
                    counts[int(i)] = counts.get(int(i), 0) + int(n)
                for i, n in zip(ids[m], size[q] @ mine, strict=True):
                    counts[int(i)] = counts.get(int(i), 0) + int(n)
                # Spanning links: each linked member to one home vector, and home vectors that share a member.
                first = linked.argmax(0)
                some = np.flatnonzero(linked.any(0))
                u += ids[m][some].tolist()
                v += ids[q][first[some]].tolist()
                for k in np.flatnonzero(linked.any(1)):
                    u.append(int(ids[q][k]))
                    v.append(int(ids[m][linked[k].argmax()]))
                    hit = np.unique(first[some][linked[k][some]])
                    u += [int(ids[q][k])] * len(hit)
                    v += ids[q][hit].tolist()
            counts = {k: n for k, n in counts.items() if n}
            pairs = {(int(max(p)), int(min(p))) for p in zip(u, v, strict=True) if p[0] != p[1]}
            rows = [(k, n, None) for k, n in counts.items()] + [(p, None, o) for p, o in pairs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "n", "other"])

    return run


def cap_near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``."""
    vec, label = F.col(vec_col), F.col(label_col).cast("long")
    fine = vec.isNotNull() & label.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vec.alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"))
    nodes = common.written(rows.where("fine").groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    total = nodes.count()
    words = int(max(8, np.ceil((6.5 * max(total, 1)) ** (1 / BLOCKS))))
    common.ship(df.sparkSession)
    keys = ["label", "d", "filter"]
    homed = common.written(_decoded(nodes, words), "homes")
    at_home = homed.select("label", "d", "id", F.explode("homes").alias("filter"))
    homes = at_home.groupBy(*keys).agg(F.count("*").alias("n_home"))
    members = common.written(homed.select("label", "d", "id", F.explode("filters").alias("filter")).join(homes, keys), "members")
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n_member")).where("n_member > 1")
    sized = lambda rows: rows.withColumn("parts", F.ceil(F.col("n_member") / DEALT)).withColumn("home_parts", F.ceil(F.col("n_home") / DEALT))
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    as_member = sized(members.join(sizes, keys)).select("*", mine.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("home_parts") - 1)).alias("home_part"), F.lit(False).alias("is_home"))
    home_mine = F.pmod(F.xxhash64("id", F.lit(1)), F.col("home_parts"))
    as_home = sized(at_home.join(homes, keys).join(sizes, keys)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), home_mine.alias("home_part"), F.lit(True).alias("is_home"))
    meet = as_member.unionByName(as_home).select(F.xxhash64(*keys, "part", "home_part").alias("key"), *PLACE[1:], "id", "is_home")
    meet = meet.join(nodes.select("id", "n", "vec").join(homed.select("id", "homes"), "id"), "id").select(*PLACE, "id", "is_home", "n", "vec", "homes").repartition("key").sortWithinPartitions(*PLACE)
    found = common.written(meet.mapInArrow(_verify(words, cosine), "id long, n long, other long"), "found")
    links = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    of = nodes.select("label", "vec", F.col("id").alias("rep"), F.col("n").alias("copies")).join(links.withColumnRenamed("id", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    good = rows.where("fine").join(of, ["label", "vec"]).select(
        F.col("id").alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    rest = rows.where("not fine").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
