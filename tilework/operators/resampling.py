"""Bootstrap, permutation and seeded order. All draws are hashes of keys, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions.columns import unit_hash

from .quantiles import percentiles
from .shared import written


#: Targets that are drawn from in one task.
BLOCK = 65_536
#: Groups whose blocks are drawn from in one task, about.
TOGETHER = 8
#: Batches of targets that share permutations, and the most candidates of a target that shares them.
BATCHES, MOST_PLACES = 8192, 2048
_FACTOR, _MASK, _STEP = 73244475, 4294967295, 40503


def _base(x: int) -> int:
    """A 32-bit number from a 32-bit number."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * _FACTOR) & _MASK
    return x ^ (x >> 16)


def bootstrap_means(df: DataFrame, value: str | Sequence[str], key: str, groups: Sequence[str] = (), replicates: int = 2000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Means of per-target values, and the 2.5 and 97.5 percentiles of means of resamples: ``mean, lo, hi, n`` per group for one
    value, ``<value>_mean, <value>_lo, <value>_hi, n`` for several.

    ``df`` is a per-target table (one row per target and group); rows without one of the values are left out. A group is
    dealt to blocks of about ``block`` targets by a hash of the key. How many of a replicate's draws fall in each block is a
    multinomial draw over the blocks' sizes; inside a block, targets go by key, and slots draw places by a hash of replicate and slot. So a
    block gives one row of sums a replicate, nothing larger than that is shuffled, and no group is ordered. Draws depend on seed, sizes
    and keys alone: groups over the same targets share them, so differences between groups pair. Such groups (some :data:`TOGETHER` a task) are
    drawn for once: a draw is counted at its place, and the counts times the values of all groups are the sums.
    """
    names = [value] if isinstance(value, str) else list(value)
    some = [F.col(c).isNotNull() for c in names]
    rows = df.where(reduce(lambda a, b: a & b, some))
    tag = F.to_json(F.struct(*groups)) if groups else F.lit("")
    rows = written(rows.select(tag.alias("_g"), *groups, F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)]), "resampled")
    whole = rows.groupBy("_g", *groups).agg(*[F.avg(f"_v{i}").alias(f"_mean{i}") for i in range(len(names))], F.count("*").alias("n"))
    bundles = max(1, -(-whole.count() // TOGETHER))
    dealt = rows.join(whole.select("_g", F.ceil(F.col("n") / block).alias("_blocks")), "_g").withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")))
    dealt = dealt.withColumn("_bundle", F.pmod(F.xxhash64("_g"), F.lit(bundles)))
    base = np.array([_base(r + seed * 1_000_003 + 1) for r in range(replicates)], np.uint32)
    width = len(names)

    def shares(table):
        """Draws of each replicate in each block; a row for each of a group's blocks."""
        order = np.argsort(table.column("_block").to_numpy())
        sizes, rng = table.column("_size").to_numpy()[order], np.random.default_rng(seed)
        left, rest, out = np.full(replicates, sizes.sum()), int(sizes.sum()), []
        for size in sizes.tolist():
            out.append(rng.binomial(left, size / rest) if size < rest else left)
            left, rest = left - out[-1], rest - size
        first = {c: table.column(c).take(pa.array(order)) for c in ("_g", "_bundle", "_blocks", "_block")}
        return pa.table(first | {"_draws": pa.array([x.tolist() for x in out], pa.list_(pa.int64()))})

    def counts(many, salt, n):
        """How often each of ``n`` places is drawn: a matrix of some replicates at a time. Numbers of 32 bits wrap as the masks of
        :func:`_base` say, and a piece of draws fits the processor's cache."""
        slots = (np.arange(many.max(), dtype=np.uint64) + np.uint64(salt)).astype(np.uint32) * np.uint32(_STEP)
        at_once = max(1, 65_536 // max(1, len(slots), n))
        whole = many.min() == len(slots)
        for first in range(0, replicates, at_once):
            part = slice(first, min(replicates, first + at_once))
            x = base[part, None] + slots
            for _ in range(2):
                x = (x ^ (x >> np.uint32(16))) * np.uint32(_FACTOR)
            x ^= x >> np.uint32(16)
            x -= x // np.uint32(n) * np.uint32(n)
            x = x.astype(np.int64) + np.arange(len(x))[:, None] * n
            drawn = x.ravel() if whole else x[np.arange(len(slots)) < many[part, None]]
            yield part, np.bincount(drawn, minlength=len(x) * n).reshape(-1, n)

    def sums(table, draws):
        many_of = dict(zip(draws.column("_g").to_pylist(), draws.column("_draws"), strict=True))
        table = table.take(pc.sort_indices(table, [("_g", "ascending"), ("_key", "ascending")]))
        values, found, alike = np.stack([table.column(f"_v{i}").to_numpy() for i in range(width)], 1), table.column("_g").combine_chunks().dictionary_encode(), {}
        codes = found.indices.to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes)).tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            name = found.dictionary[int(codes[lo])].as_py()
            many = np.array(many_of[name].as_py())
            alike.setdefault((hi - lo, many.tobytes()), (many, []))[1].append((name, values[lo:hi]))
        salt, out = draws.column("_block")[0].as_py() * 1_000_003, []
        for (n, _), (many, members) in alike.items():  # groups with the same sizes draw the same places
            side = np.concatenate([v for _, v in members], 1)
            total = np.zeros((replicates, side.shape[1]))
            for part, drawn in counts(many, salt, n):
                total[part] = drawn @ side if n < 1024 else drawn.astype(np.float64) @ side
            for j, (name, _) in enumerate(members):
                out.append(pa.table({"_g": pa.array([name] * replicates, pa.string()), "_rep": pa.array(np.arange(replicates), pa.int32())} | {f"_s{i}": pa.array(total[:, j * width + i]) for i in range(width)}))
        return pa.concat_tables(out)

    blocks = dealt.groupBy("_g", "_bundle", "_blocks", "_block").agg(F.count("*").alias("_size"))
    draws = blocks.groupBy("_g").applyInArrow(shares, "_g string, _bundle long, _blocks long, _block long, _draws array<long>")
    place = ["_bundle", "_blocks", "_block"]
    keyed = dealt.drop(*groups).groupBy(*place).cogroup(draws.groupBy(*place))
    parts = keyed.applyInArrow(sums, "_g string, _rep int, " + ", ".join(f"_s{i} double" for i in range(width)))
    totals = parts.groupBy("_g", "_rep").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(width)])
    ends = totals.groupBy("_g").agg(*[F.percentile(f"_s{i}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"_e{i}") for i in range(width)])  # a row a replicate
    if not groups:
        whole = rows.agg(F.lit("").alias("_g"), *[F.avg(f"_v{i}").alias(f"_mean{i}") for i in range(width)], F.count("*").alias("n"))
    out = [[F.col(f"_mean{i}").alias(f"{p}mean"), *[(F.col(f"_e{i}")[k] / F.col("n")).alias(f"{p}{end}") for k, end in enumerate(("lo", "hi"))]] for i, p in enumerate([""] if isinstance(value, str) else [f"{c}_" for c in names])]
    return whole.join(ends, "_g", "left").select(*groups, *[c for part in out for c in part], "n")


def paired_bootstrap(df: DataFrame, value: str, key: str, method: str, base, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """``mean, lo, hi, n`` of each method's difference from the method ``base``, over the targets that both have: both are resampled
    with the same draws."""
    other = F.max(F.when(F.col(method) == base, F.col(value))).over(Window.partitionBy(key))  # a row a method
    both = df.where(F.col(key).isNotNull()).withColumn("_base", other).where(F.col(method) != base).withColumn("_delta", F.col(value) - F.col("_base"))
    return bootstrap_means(both, "_delta", key, (method,), replicates, seed)


def value_interval(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean with the 2.5 and 97.5 percentiles of the values themselves."""
    df = written(df.select(*groups, value), "values")
    whole = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    ends = percentiles(df, value, {"lo": 0.025, "hi": 0.975}, groups)
    if not groups:
        return whole.crossJoin(ends).select("mean", "lo", "hi", "n")  # one row each
    ends = ends.withColumnsRenamed({g: f"_{g}" for g in groups})
    return whole.join(ends, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]).select(*groups, "mean", "lo", "hi", "n")


def permutation_test(ranked: DataFrame, key: str = "record_id", replicates: int = 5000, seed: int = 0, rows_a_part: int = 100_000) -> DataFrame:
    """One-sided p of the mean per-target rank correlation under shuffling within targets.

    ``ranked`` has target_id, the key and average ranks ``ra`` and ``rb``. Every target is put in a random order of its own, by a hash of
    target and key. Targets of equal size are dealt to batches by a hash, and a batch draws the replicates' permutations, which its targets apply to their
    own orders. So in each replicate every target has a uniform shuffle independent of the others, and the expected count of
    replicates above the observed mean is exact. Replicates of one batch are dependent through the orders, which
    some :data:`BATCHES` batches average out; up to that many targets, each is a batch of its own. A batch needs only the sum of the outer products of its targets'
    sides, from which each replicate reads one number a place: shuffling costs the same for any number of targets.
    Results do not depend on how batches are dealt to tasks of about ``rows_a_part`` rows. Targets with a constant side take no part;
    larger ones than :data:`MOST_PLACES` are batches of their own.
    """

    def permuted(rng, n):
        at_once = max(1, 500_000 // n)
        for first in range(0, replicates, at_once):
            many = min(at_once, replicates - first)
            yield slice(first, first + many), rng.permuted(np.tile(np.arange(n, dtype=np.int32), (many, 1)), axis=1)

    def batch_sums(name, a, b):
        """The sum over targets (rows of ``a`` and ``b``, each of length 1) for every replicate."""
        n, out = a.shape[1], np.zeros(replicates)
        if len(a) == 1:
            for part, order in permuted(np.random.default_rng(name), n):
                out[part] = a[0][order] @ b[0]
            return out
        products, rows = (b.T @ a).ravel(), np.arange(n, dtype=np.int32) * n
        for part, order in permuted(np.random.default_rng(name), n):
            out[part] = products[order + rows].sum(1)
        return out

    def shuffled(table):
        size, batch, target, ra, rb = (table.column(c).to_numpy() for c in ("_size", "_batch", "_t", "ra", "rb"))
        order = np.lexsort((table.column("_k").to_numpy(), target, batch, size))
        size, batch, target, ra, rb = (x[order] for x in (size, batch, target, ra, rb))
        total, observed, targets = np.zeros(replicates), 0.0, 0
        bounds = np.append(np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (batch[1:] != batch[:-1]))), len(size)).tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            n = int(size[lo])
            a, b = (x[lo:hi].reshape(-1, n) for x in (ra, rb))
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            scale = np.sqrt((a * a).sum(1) * (b * b).sum(1))
            a, b, scale = a[scale > 0], b[scale > 0], scale[scale > 0, None]
            if len(a):
                a = a / scale
                observed, targets = observed + (a * b).sum(), targets + len(a)
                total += batch_sums([seed, n, int(batch[lo]) & (2**63 - 1)], a, b)
        return pa.table({"rep": pa.array(np.arange(-1, replicates)), "sum": pa.array(np.append(observed, total)), "n": pa.array(np.full(replicates + 1, targets))})

    known = ranked.agg(F.count("*").alias("rows"), F.count_distinct("target_id").alias("targets")).first()
    together = max(1, known.targets // BATCHES)
    parts = max(16, known.rows // rows_a_part)
    sized = ranked.withColumn("_size", F.count("*").over(Window.partitionBy("target_id")))
    rows = sized.select(F.xxhash64("target_id").alias("_t"), F.xxhash64("target_id", key).alias("_k"), F.col("ra").cast("double"), F.col("rb").cast("double"), "_size")
    sizes = ranked.groupBy("target_id").agg(F.count("*").alias("_s")).groupBy("_s").agg(F.ceil(F.count("*") / together).alias("_batches"))
    alone = (F.col("_size") > MOST_PLACES) | F.lit(together == 1)
    rows = rows.join(F.broadcast(sizes), F.col("_size") == F.col("_s"))  # a row a size, at most the root of twice the rows
    rows = rows.withColumn("_batch", F.when(alone, F.col("_t")).otherwise(F.pmod("_t", F.col("_batches")))).drop("_s", "_batches")
    dealt = rows.groupBy(F.pmod(F.xxhash64("_size", "_batch"), F.lit(parts)).alias("_part"))
    sums = dealt.applyInArrow(shuffled, "rep long, sum double, n long")
    means = sums.groupBy("rep").agg((F.sum("sum") / F.sum("n")).alias("mean"), F.sum("n").alias("targets"))
    observed = means.where("rep = -1").select(F.col("mean").alias("observed"), "targets")  # one row
    null = means.where("rep >= 0").select("mean").crossJoin(F.broadcast(observed))
    return null.groupBy("observed", "targets").agg(((F.count_if(F.col("mean") >= F.col("observed") - 1e-12) + 1) / F.lit(replicates + 1.0)).alias("p"))


def shuffled_rank(df: DataFrame, keys: Sequence[str] = ("target_id",), seed: int = 0, name: str = "rn") -> DataFrame:
    """A seeded random order within groups."""
    order = Window.partitionBy(*keys).orderBy(unit_hash(seed, *[F.col(k) for k in keys], F.col("record_id")), "record_id")
    return df.withColumn(name, F.row_number().over(order))
