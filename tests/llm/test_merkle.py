import hashlib
import random
import zlib

from tilework.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """Levels of a tree over ``nodes``, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 16]) for i in range(0, len(now), 16)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], s, r[2], r[4], r[1])))
        trees[s] = tree([leaf(r[0], s, r[2], r[4], r[1]) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x, proof = leaf(r[0], s, r[2], r[4], text), ""
            for left, right in [*siblings(trees[s], at), *siblings(top, k)]:
                proof += "".join(left) + "".join(right)
                x = h(*left, x, *right)
            root = top[-1][0]
            out.append((r[0], s, trees[s][0][at], trees[s][-1][0], root, h(proof), x, x == root))
    return sorted(out, key=str)


def rows(n, sources, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abAB é\U0001f600") for _ in range(r.randint(0, 12)))
    return [(i, r.choice([word(), word(), None]), r.choice(["en", None]), r.choice(sources), r.choice([None, i]), i) for i in range(n)]


def check(spark, data):
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = sorted(map(tuple, merkle.audit(docs, again=merkle.lower_one_in_five).collect()), key=str)
    assert got == plain(data)
    return got


def test_heights_null_sources_and_hot_source(spark):
    """One source of three levels, small ones of one and of a lone leaf, a null one; 18 sources, so two levels above them."""
    data = rows(500, ["hot"] * 30 + ["a", "Z", "é", None] + [f"s{i}" for i in range(12)], 3) + [(900, "X" * 70_000, None, "lone", 1, 0), (901, None, None, "\U0001f600", None, 0)]
    data += [(1000, "Same", "en", "hot", 4, 0), (1000, "Same", "en", "hot", 4, 0), (1000, "other", "en", "hot", 4, 0), (None, "No Id", "en", "hot", 4, 0), (None, "No Id", "en", None, 4, 0)]
    got = check(spark, data)
    assert len(got) == len(data) and 0 < sum(not x[7] for x in got) < len(got)


def test_runs_of_sixteen(spark):
    for n in (1, 257):
        check(spark, rows(n, ["one"], n))


def test_empty_and_untampered(spark):
    docs = spark.createDataFrame(rows(40, ["a", "b"], 1), SCHEMA)
    assert merkle.audit(docs.limit(0)).count() == 0 and merkle.manifest(docs.limit(0)).count() == 0
    assert merkle.audit(docs).where("verified").count() == 40


def test_manifest_intervals(spark):
    data = rows(300, ["a", "b", "b", None], 8)
    nodes = merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()
    root = plain(data)[0][4]
    tops = [x for x in nodes if x.of_sources]
    assert [(x.lo, x.hi, x.digest) for x in tops] == [(0, 3, root)]
    for s in ("a", "b", None):
        n = sum(x[3] == s for x in data)
        for level in {x.level for x in nodes if x.source == s and not x.of_sources}:
            cover = sorted((x.lo, x.hi) for x in nodes if x.source == s and x.level == level and not x.of_sources)
            assert cover == [(lo, min(lo + 16**level, n)) for lo in range(0, n, 16**level)]
