import numpy as np
import pytest

from tilework.llm import ann, capdedup, components


def table(spark, x, labels=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], None if labels is None else labels[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clusters(n, d, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, d))
    x = centre[rng.integers(0, 12, n)] + 0.12 * rng.standard_normal((n, d))
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 3).astype(np.float32)


def test_nearest_on_a_small_table(spark):
    x = [*clusters(400, 16, 0), None, [0.0] * 16, [np.nan] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    x += [x[20]] * 60
    got = ann.nearest(table(spark, x), lambda i: i % 20 == 0).collect()
    good = [i for i, v in enumerate(x) if i < 400 or i >= 405]
    m = np.array([x[i] for i in good], float)
    found = total = 0
    for q in [i for i in good if i % 20 == 0]:
        s = m @ np.array(x[q], float)
        best = [k for k in sorted(range(len(good)), key=lambda k: (-round(s[k], 12), good[k])) if good[k] != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(np.dot(np.array(x[q], float), np.array(x[r.vec_id], float)))) for r in mine)
        found += len({r.vec_id for r in mine} & {good[k] for k in best})
        total += 20
    assert found / total >= 0.9
    assert {r.query_id for r in got} == {i for i in good if i % 20 == 0}


def recall(got, x, queries, k=20):
    found = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        found += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return found / (k * len(queries))


@pytest.mark.parametrize("kind", ["unit", "one long", "spread", "one cluster"])
def test_recall_of_the_graph(spark, kind):
    """The start compares a small part of all pairs and has a low recall; rounds and search bring it up, whatever the lengths."""
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.standard_normal((n, 16))
    if kind == "one cluster":
        x[: n // 3] = rng.standard_normal(16) * 2 + 0.3 * rng.standard_normal((n // 3, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[7] *= 1000
    if kind == "spread":
        x *= 10 ** rng.uniform(-2, 2, (n, 1))
    x = x.astype(np.float32).astype(np.float64)
    rows = table(spark, x)
    if kind == "unit":
        vectors = ann.usable(rows, "vec_id", "embedding")
        codes = ann.encode(vectors, cell=32)
        start = ann._by_id(ann._start(codes, ann.K, 32)).mapInArrow(ann._merge(ann.K), ann.LIST)
        lists = {r.id: np.frombuffer(r.ids, np.int64)[:20] for r in start.collect()}
        best = [set(np.argsort(-np.where(np.arange(n) == q, -9, x @ x[q]))[:20].tolist()) for q in range(0, n, 20)]
        assert np.mean([len(b & set(lists[q].tolist())) / 20 for q, b in zip(range(0, n, 20), best)]) < 0.6
    got = ann.nearest(rows, lambda i: i % 20 == 0, cell=32).collect()
    assert recall(got, x, range(0, n, 20)) >= 0.95


def test_nearest_few_rows(spark):
    got = ann.nearest(table(spark, [[2.0, 0.0], [1.0, 1.0], [0.0, 3.0]]), lambda i: i % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
    assert ann.nearest(table(spark, []), lambda i: i % 20 == 0).count() == 0


def test_caps_against_all_pairs(spark):
    x = list(clusters(500, 32, 1))
    x += [x[3]] * 20 + [None, [0.0] * 32, [np.inf] * 32, [1.0] * 31]
    labels = [int(i % 3) for i in range(len(x))]
    labels[5] = None
    got = {r.vec_id: r for r in capdedup.cap_near_duplicates(table(spark, x, labels)).collect()}
    assert len(got) == len(x)
    good = [i for i, v in enumerate(x) if labels[i] is not None and not 520 <= i]
    m = np.array([x[i] for i in good], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.93) & (np.array([labels[i] for i in good])[:, None] == np.array([labels[i] for i in good]))
    np.fill_diagonal(link, False)
    want = link.sum(1)
    have = np.array([got[i].n_links for i in good])
    assert have.sum() >= 0.99 * want.sum() and (have <= want).all()
    for i in (5, 520, 521, 522, 523):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    part = {i: i for i in good}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in zip(*np.nonzero(link)):
        r, s = sorted((root(good[a]), root(good[b])))
        part[s] = r
    assert np.mean([got[i].component_id == root(i) for i in good]) >= 0.99
    assert capdedup.cap_near_duplicates(table(spark, [], [])).count() == 0


@pytest.mark.parametrize("words", [12, 25, 50])
def test_pairs_at_the_bound_meet(words):
    """Pairs at a cosine of 0.93 have a home of one in the caps of the other as often with large codes as with small ones."""
    rng = np.random.default_rng(words)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.standard_normal((150, 64))), rng.standard_normal((150, 64))
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * unit(b - (a * b).sum(1, keepdims=True) * a)
    code = capdedup.CapCode(64, words)
    one, two = code.products(a), code.products(b)
    homes = [np.stack([code.decode(p)[0] for p in x]) for x in (one, two)]
    lists = [[set(code.decode(p)[1].tolist()) for p in x] for x in (one, two)]
    in_two, in_one = code.inside(two, homes[1], homes[0]), code.inside(one, homes[0], homes[1])
    assert (in_two.any(1) | in_one.any(1)).mean() >= 0.93
    assert all(in_two[i, k] == (int(h) in lists[1][i]) for i in range(150) for k, h in enumerate(homes[0][i]))  # as listed


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and all(got[k] == 200 for k in range(200, 260))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
