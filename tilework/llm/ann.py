"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, searched greedily.

Graph work uses 8-bit codes with a scale for each vector, so that vectors of any length keep their precision; results are scored on
the original vectors in double precision.

* Start: seeded random hyperplanes put the vectors in small cells of about ``CELL`` rows (larger cells are dealt by hash), ``TABLES``
  times; each cell is compared in one block. This graph alone has a low recall.
* NN-descent: every vertex brings its neighbours and a bounded number of those it is a neighbour of together; pairs in which one
  is new there are compared, and whatever beats somebody's worst neighbour is sent to it. One round is a join on the
  neighbour, a shuffle by the vertex and a merge by the receiver. Rounds end when at most ``CHANGED`` of all entries are new.
* Search: from its own vertex, each query expands its best unexpanded vertices by a join with the graph, and keeps a
  pool of the best found, until its nearest do not change.

Equal vectors are one vertex; a result lists the smallest ids of each vertex, so that ties go to smaller ids.
Vectors that are null, zero, of another than the most common length, or hold null or non-finite components take no
part. Rows that repeat an id are separate candidates unless their vectors agree; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, REVERSE, SENT, TABLES, CELL, CHANGED, MOST_ROUNDS = 56, 40, 16, 4, 512, 0.06, 40
EXPAND, POOL, MOST_STEPS = 160, 240, 40
LIST = "id long, ids binary, sims binary, new binary"


def usable(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """``id, vec`` (and more columns) of the vectors that take part."""
    vec = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = df.where(vec.isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"), *more)
    sizes = out.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return out.where(F.size("vec") == (sizes.n if sizes else 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _coded(x: np.ndarray, unit: float) -> list[bytes]:
    """For each row its scale (float32, in ``unit``) and its components as 8-bit numbers."""
    most = np.abs(x).max(1)
    code = np.rint(x * (127 / most)[:, None]).astype(np.int8)
    return [s + c.tobytes() for s, c in zip((most / (127 * unit)).astype("<f4")[:, None].view("S4").ravel().tolist(), code, strict=True)]


def _codes(blobs: list[bytes]) -> np.ndarray:
    """The rows that :func:`_coded` wrote, as floats."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view("<f4")


def _split(blob: bytes, size: int) -> list[bytes]:
    return [blob[i : i + size] for i in range(0, len(blob), size)]


def _lists(ids, parts_ids, parts_sims, parts_new):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.binary()) for x in (parts_ids, parts_sims, parts_new))], ["id", "ids", "sims", "new"])


def _runs(batches):
    """Record batches that hold whole runs of equal values in the first column, which is sorted."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        now = table.to_batches()[0]
        key = now.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None:
        yield rest


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])


def _top(block: np.ndarray, floor: np.ndarray, count: int):
    """Places and values of each row's ``count`` largest entries above its floor."""
    count = min(count, block.shape[1])
    at = np.argpartition(-block, count - 1, axis=1)[:, :count]
    value = np.take_along_axis(block, at, 1)
    return at, value, value > floor[:, None]


def _merge(k: int):
    """Merges the lists that each id has received to its ``k`` best; entries that its own list did not have are new."""

    def run(batches):
        for run_ in _runs(batches):
            ids, sims, news = (run_.column(i).to_pylist() for i in (1, 2, 3))
            n = np.array([len(x) // 8 for x in ids])
            u = np.repeat(run_.column(0).to_numpy(), n)
            v, s, new = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float32), np.frombuffer(b"".join(news), np.uint8)
            order = np.lexsort((new, v, -s, u))
            u, v, s, new = u[order], v[order], s[order], new[order]
            other = np.ones(len(u), bool)  # equal pairs have equal similarity and so are neighbours here
            other[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            other &= u != v
            u, v, s, new = u[other], v[other], s[other], new[other]
            if len(u):
                b = _bounds(u)
                parts = list(zip(b[:-1].tolist(), np.minimum(b[:-1] + k, b[1:]).tolist(), strict=True))
                yield _lists(u[b[:-1]], *([c[x:y].tobytes() for x, y in parts] for c in (v, s, new)))

    return run


def _by_id(df: DataFrame, key: str = "id") -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def encode(vectors: DataFrame, seed: int = 7, cell: int = CELL, tables: int = TABLES) -> DataFrame:
    """``id, code, cells``: the code and a cell for each table; ``vectors`` has id and vec."""
    s = vectors.select(F.array_max(F.transform("vec", F.abs)).alias("most"), F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max("most").alias("most"), F.max("d").alias("d")).first()
    unit, n, d = s.most or 1.0, s.n, s.d or 1
    planes = max(0, round(np.log2(max(n, 1) / (0.8 * cell))))
    normals = np.random.default_rng(seed).standard_normal((d, tables * planes)).astype(np.float32)
    direction = lambda x: x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True)
    # The middle of each projection, from a bounded sample of the vectors.
    sample = np.array([r.vec for r in vectors.orderBy(F.xxhash64("id"), "id").limit(2000).collect()], np.float64).reshape(-1, d)
    middle = np.median(direction(sample) @ normals, axis=0) if len(sample) and planes else np.zeros(tables * planes)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            side = ((direction(x) @ normals) > middle).reshape(len(x), tables, planes)
            cells = (side << np.arange(planes)).sum(-1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_coded(x, unit), pa.binary()), pa.array(list(cells), pa.list_(pa.int64()))], ["id", "code", "cells"])

    common.ship(vectors.sparkSession)
    return vectors.select("id", "vec").mapInArrow(run, "id long, code binary, cells array<long>")


def _start(codes: DataFrame, k: int, cell: int) -> DataFrame:
    """Each cell compared in one block of about ``cell`` rows."""
    at = codes.select("id", "code", F.posexplode("cells").alias("part", "cell"))
    sizes = at.groupBy("part", "cell").agg(F.count("*").alias("n"))
    at = at.join(sizes, ["part", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.ceil(F.col("n") / cell)))
    at = at.select(F.xxhash64("part", "cell", "salt").alias("block"), "id", "code")

    def blocks(batches):
        for r in _runs(batches):
            ids_, codes_ = r.column(1).to_numpy(), r.column(2).to_pylist()
            for a, b in zip(*(lambda x: (x[:-1].tolist(), x[1:].tolist()))(_bounds(r.column(0).to_numpy())), strict=True):
                ids, x = ids_[a:b], _codes(codes_[a:b])
                if len(ids) < 2:
                    continue
                sims = x @ x.T
                np.fill_diagonal(sims, -np.inf)
                place, value, ok = _top(sims, np.full(len(sims), -np.inf), k)
                got = [(ids[p[o]], v[o].astype(np.float32)) for p, o, v in zip(place, ok, value, strict=True)]
                yield _lists(ids, [i.tobytes() for i, _ in got], [v.tobytes() for _, v in got], [b"\1" * len(i) for i, _ in got])

    return _by_id(at, "block").mapInArrow(blocks, LIST)


def _pairs(lists: DataFrame) -> DataFrame:
    """``id, nbr``."""

    def run(batches):
        for b in batches:
            ids = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in ids])), pa.array(np.frombuffer(b"".join(ids), np.int64))], ["id", "nbr"])

    return lists.select("id", "ids").mapInArrow(run, "id long, nbr long")


def _edges(graph: DataFrame) -> DataFrame:
    """``id, nbr, new``."""

    def run(batches):
        for b in batches:
            ids, new = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in ids])), pa.array(np.frombuffer(b"".join(ids), np.int64)), pa.array(np.frombuffer(b"".join(new), np.uint8) > 0)], ["id", "nbr", "new"])

    return graph.select("id", "ids", "new").mapInArrow(run, "id long, nbr long, new boolean")


def _back(edges: DataFrame, reverse: int) -> DataFrame:
    """``at, member, new``: for each vertex a bounded number of those it is a neighbour of, new ones first."""
    place = F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("new"), F.xxhash64("id", "nbr"), "id"))
    return edges.withColumn("place", place).where(F.col("place") <= reverse).select(F.col("nbr").alias("at"), F.col("id").alias("member"), "new")


def _descend(graph: DataFrame, codes: DataFrame, k: int, reverse: int, sent: int) -> DataFrame:
    """One round of NN-descent: neighbours of a common vertex meet there."""
    edges = _edges(graph)
    back = _back(edges, reverse)
    meet = edges.select(F.col("id").alias("at"), F.col("nbr").alias("member"), "new").union(back)

    def worst(batches):
        for b in batches:
            sims = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(s, np.float32)[-1] if len(s) >= 4 * k else -np.inf for s in sims], pa.float32())], ["id", "worst"])

    facts = codes.select("id", "code").join(graph.select("id", "sims").mapInArrow(worst, "id long, worst float"), "id")
    meet = _by_id(meet.join(facts, meet["member"] == facts["id"]).select("at", "member", "code", "worst", "new"), "at")

    def local_join(batches):
        for run_ in _runs(batches):
            key, member, worst_, new_ = (run_.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            codes_ = run_.column(2).to_pylist()
            bounds = _bounds(key)
            who, got_ids, got_sims = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                new = new_[a:b]
                if not new.any():
                    continue
                order = np.argsort(~new, kind="stable")  # of a member that comes twice, the new one
                ids, first = np.unique(member[a:b][order], return_index=True)
                if len(ids) < 2:
                    continue
                first = order[first]
                y, new = _codes([codes_[a + i] for i in first.tolist()]), new[first]
                sims = y @ y.T
                np.fill_diagonal(sims, -np.inf)
                sims[np.ix_(~new, ~new)] = -np.inf  # these have met
                at, value, ok = _top(sims, worst_[a:b][first], sent)
                for i in np.flatnonzero(ok.any(1)):
                    who.append(ids[i])
                    got_ids.append(ids[at[i][ok[i]]].tobytes())
                    got_sims.append(value[i][ok[i]].astype(np.float32).tobytes())
            if who:
                yield _lists(who, got_ids, got_sims, [b"\1" * (len(x) // 8) for x in got_ids])

    def old(batches):
        for b in batches:
            yield _lists(b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist(), [bytes(len(x) // 8) for x in b.column(1).to_pylist()])

    return _by_id(graph.mapInArrow(old, LIST).union(meet.mapInArrow(local_join, LIST))).mapInArrow(_merge(k), LIST)


def build_graph(codes: DataFrame, k: int = K, reverse: int = REVERSE, sent: int = SENT, cell: int = CELL, changed: float = CHANGED, rounds: int | None = None) -> DataFrame:
    """``id, ids, sims, new``: for each id its ``k`` nearest found, nearest first (binary arrays of int64, float32 and bytes).
    Ends after ``rounds``, or when the graph hardly changes; a graph that does not settle raises."""
    graph = common.written(_by_id(_start(codes, k, cell)).mapInArrow(_merge(k), LIST), "graph")
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        new = common.written(_descend(graph, codes, k, reverse, sent), "graph")
        common.forget(graph)
        graph = new
        # A new entry is a byte 1, an old one a byte 0.
        share = graph.agg(F.sum(F.length(F.translate(F.col("new").cast("string"), "\0", ""))).alias("new"), F.sum(F.length("new")).alias("n")).first()
        if not share.n or share.new <= changed * share.n:
            return graph
    if rounds is None:
        raise RuntimeError("the neighbour graph did not settle")
    return graph


def _with_codes(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """``node, ids, code``: each vertex with the ids and codes, joined end to end, of its neighbours and of some it is a neighbour of."""
    edges = _edges(graph)
    edges = edges.select("id", "nbr").union(_back(edges, REVERSE).select(F.col("at").alias("id"), F.col("member").alias("nbr"))).distinct()
    rows = _by_id(edges.join(codes.select(F.col("id").alias("nbr"), "code"), "nbr").select("id", "nbr", "code"))

    def run(batches):
        for r in _runs(batches):
            b = _bounds(r.column(0).to_numpy())
            ids, code = r.column(1).to_numpy(), r.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(r.column(0).to_numpy()[b[:-1]]), pa.array([ids[x:y].tobytes() for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary()), pa.array([b"".join(code[x:y]) for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary())], ["node", "ids", "code"])

    return rows.mapInArrow(run, "node long, ids binary, code binary")


def greedy_search(graph: DataFrame, codes: DataFrame, queries: DataFrame, near: int = 20, expand: int = EXPAND, pool: int = POOL) -> DataFrame:
    """``id, ids, sims``: the pool of each query vertex (``queries`` has id), once an expansion did not change its ``near`` best."""
    from_own = graph.join(queries.select("id").distinct(), "id").join(codes.select("id", "code"), "id")
    state = common.written(from_own.select("id", "ids", "sims", "code", F.lit(b"").alias("done"), F.lit(True).alias("open")), "pool")
    lists = common.written(_with_codes(graph, codes), "near")

    def frontier(batches):
        for b in batches:
            rows = []
            for q, ids, sims, code, done in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v, s = np.frombuffer(ids, np.int64), np.frombuffer(sims, np.float32)
                todo = v[~np.isin(v, np.frombuffer(done, np.int64))][:expand]
                floor = float(s[pool - 1]) if len(s) >= pool else -np.inf
                rows += [(q, int(x), code, floor) for x in todo]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.float32()), strict=True)], ["id", "node", "own", "floor"])

    def score(batches):
        for b in batches:
            q, own, floor, ids, code, nodes = (b.column(i).to_pylist() for i in range(6))
            got_ids, got_sims = [], []
            for i in range(len(q)):
                s = _codes(_split(code[i], len(own[i]))) @ _codes([own[i]])[0]
                ok = s > floor[i]
                got_ids.append(np.frombuffer(ids[i], np.int64)[ok].tobytes())
                got_sims.append(s[ok].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(got_ids, pa.binary()), pa.array(got_sims, pa.binary()), pa.nulls(len(q), pa.binary()), pa.array([np.int64(x).tobytes() for x in nodes], pa.binary()), pa.nulls(len(q), pa.bool_())], names)

    def gather(batches):
        for r in _runs(batches):
            key = r.column(0).to_numpy()
            ids, sims, code, done = (r.column(i).to_pylist() for i in range(1, 5))
            rows = []
            for a, b in zip(*(lambda x: (x[:-1].tolist(), x[1:].tolist()))(_bounds(key)), strict=True):
                v, s = np.frombuffer(b"".join(ids[a:b]), np.int64), np.frombuffer(b"".join(sims[a:b]), np.float32)
                v, first = np.unique(v, return_index=True)
                s = s[first]
                s, v = s[v != key[a]], v[v != key[a]]
                order = np.lexsort((v, -s))[:pool]
                own = next(i for i in range(a, b) if code[i] is not None)
                before = np.frombuffer(ids[own], np.int64)
                rows.append((int(key[a]), v[order].tobytes(), s[order].tobytes(), code[own], b"".join(done[a:b]), set(v[order[:near]].tolist()) != set(before[:near].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4, pa.bool_()), strict=True)], names)

    names = ["id", "ids", "sims", "code", "done", "open"]
    schema = "id long, ids binary, sims binary, code binary, done binary, open boolean"
    ready = state.where("not open")
    for _ in range(MOST_STEPS):
        going = state.where("open")
        front = going.select("id", "ids", "sims", "code", "done").mapInArrow(frontier, "id long, node long, own binary, floor float")
        found = front.join(lists, "node").select("id", "own", "floor", "ids", lists["code"], "node").mapInArrow(score, schema)
        state = common.written(_by_id(going.union(found)).mapInArrow(gather, schema), "pool")
        ready = ready.union(state.where("not open"))
        if state.where("open").isEmpty():
            return ready.select("id", "ids", "sims")
    raise RuntimeError("the search did not settle")


def nearest(df: DataFrame, is_query, k: int = 20, cell: int = CELL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` (a condition on column ``id``) holds."""
    rows = usable(df, id_col, vec_col)
    classes = common.written(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    several = rows.join(classes.where("n > 1"), "vec").select("rep", "id")
    belongs = common.written(several.union(classes.where("n = 1").select("rep", F.col("rep").alias("id"))), "belongs")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    members = belongs.withColumn("place", place).where(F.col("place") <= k + 1).select(F.col("rep").alias("near_rep"), F.col("id").alias("vec_id"))
    vectors = classes.select(F.col("rep").alias("id"), "vec")
    codes = common.written(encode(vectors, cell=cell), "codes")
    wanted = belongs.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "rep")
    graph = build_graph(codes, cell=cell)
    pools = greedy_search(graph, codes, wanted.select(F.col("rep").alias("id")), k)
    pairs = _pairs(pools).union(wanted.select(F.col("rep").alias("id"), F.col("rep").alias("nbr")).distinct())
    pairs = pairs.join(vectors.select("id", F.col("vec").alias("a")), "id").join(vectors.select(F.col("id").alias("nbr"), F.col("vec").alias("b")), "nbr")
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    lists = pairs.select(F.col("id").alias("rep"), F.col("nbr").alias("near_rep"), score.alias("score")).join(members, "near_rep").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    out = wanted.join(lists.select("rep", "vec_id", "score"), "rep").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
