import math
import random
import re

import numpy as np
import xxhash

from tilework.llm import simhash, simhash_wide, substrings


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \n", "One", "one TWO", "Ünï CÖDE   a b", "a b c d e f g " * 50, " \t lead\x0band  trail\r\n", "x\u00a0y \x1f z"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_index_covers_every_match():
    from itertools import combinations

    for m in (5, 4, 6):
        assert all(any(set(s) <= set(c) for s in simhash.index_sets(m)) for c in combinations(range(8), m))


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:25]:
        for _ in range(30):
            x = int(b)
            for k in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in simhash.connected_components(simhash.links(nodes)).collect()}
    part = list(range(len(fps)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                r, s = sorted((root(i), root(j)))
                part[s] = r
    assert [got.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_long_lists_are_dealt_again():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**32, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp ^ np.uint64(1), fp ^ np.uint64(0x10100), fp ^ np.uint64(0x1010101)])).view(np.int64)
    rep = np.arange(len(fp))

    def parts(links):
        of = list(range(len(fp)))
        for u, v in links:
            a, b = sorted((of[u], of[v]))
            of = [a if x == b else x for x in of]
        return of

    assert parts(simhash.list_links(fp, rep, 5, 3, most=50)) == parts(simhash.spanning_links(fp, rep, 5, 3))


def test_groups_and_dedup(spark):
    docs = spark.createDataFrame([(4, "a b c d", 1), (2, "A  b c D", 1), (3, None, 1), (1, "", 1), (7, "other words entirely here", 1), (7, "other words entirely here", 1)], "doc_id long, text string, component_id int")
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert got == {4: 2, 2: 2, 3: 1, 1: 1, 7: 7}
    kept = simhash.simhash_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 7] and kept.columns == docs.columns
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def plain_removal(rows, n):
    first = {}
    for i, b in sorted(rows):
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = {}
    for i, b in rows:
        cover = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                cover[p : p + n] = b"\1" * n
        out[i, b] = (bytes(c for c, k in zip(b, cover) if not k), sum(cover), len(re.findall(b"\1+", bytes(cover))))
    return out


def check(spark, rows, n, **more):
    docs = spark.createDataFrame([(i, None if t is None else t, "x") for i, t in rows], "doc_id long, text string, mark string")
    want = plain_removal([(i, (t or "").encode()) for i, t in rows], n)
    got = substrings.remove_repeats(docs, n, **more).collect()
    assert len(got) == len(rows)
    for r, in zip(got):
        assert (bytes(r.kept), r.n_removed, r.n_spans) in [v for k, v in want.items() if k[0] == r.doc_id]


def test_removal_against_brute_force(spark):
    r = random.Random(6)
    parts = ["".join(r.choice("ab ") for _ in range(r.randint(5, 60))) for _ in range(25)] + ["é日x" * 9, "a" * 90]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1]), (3, "q" + rows[3][1]), (104, "a" * 5000)]
    check(spark, rows, 20)
    check(spark, rows[:10], 50)
    check(spark, rows, 50, buckets=2, most=3000)  # buckets too large for a task are dealt anew, up to the last round
    check(spark, [(1, "")], 50)


def test_the_sort_decides(monkeypatch):
    """Without the order of the suffixes, equal strings are no neighbours and stay."""
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab ") for _ in range(300)) for _ in range(4)]
    texts += [texts[0][40:160] + texts[1][100:220], texts[2][50:250], texts[0][30:140]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    first = {}
    want = set()
    for d, t in enumerate(texts):
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], d) < d:
                want.add((d, p))
    found = lambda: set(zip(*(x.tolist() for x in substrings.repeated(substrings.Prefix(data), start, size, np.arange(len(texts)), 50)), strict=True))
    assert want and found() == want
    monkeypatch.setattr(substrings, "suffix_sort", lambda prefix, at, length: at)
    assert found() != want


def test_frequent_seeds_are_cut_again(monkeypatch):
    """Groups over the bound are cut by longer seeds, up to whole strings, and lose nothing."""
    r = random.Random(10)
    parts = ["the very same words come up again here ", "and again " * 9, "x" * 70]
    texts = [("".join(r.choice(parts) for _ in range(6)) + str(i % 7)).encode() for i in range(30)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    start = ends - [len(t) for t in texts]
    of, at, size, least, _ = substrings.stretches(data, ends, 50, 8)
    have = substrings.Stretches(of, of * 0, at - start[of], size, substrings._kind(least), substrings._gather(data, at, size))
    for bound in (1_000_000, 500):
        monkeypatch.setattr(substrings, "GROUP_BYTES", bound)
        cover = [bytearray(len(t)) for t in texts]
        for ids, _, a, b in substrings.settle(have, 50, 0):
            for i, x, y in zip(ids.tolist(), a.tolist(), b.tolist()):
                cover[i][x:y] = b"\1" * (y - x)
        want = plain_removal(list(enumerate(texts)), 50)
        assert [sum(c) for c in cover] == [want[i, t][1] for i, t in enumerate(texts)]


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at = np.arange(350)
    got = substrings.suffix_sort(substrings.Prefix(data), rng.permutation(at), 50)
    b = data.tobytes()
    assert [b[i : i + 50] for i in got] == sorted(b[i : i + 50] for i in at)
    one, two = b"x" * 30, b"x" * 29 + b"y"
    p = substrings.Prefix(np.frombuffer(one + two, np.uint8))
    assert substrings._extension(p, np.array([0]), np.array([30]), 30)[0] == 29


def test_wide_groups(spark):
    r = random.Random(9)
    rows = []
    for k in range(30):
        words = [f"w{r.randint(0, 400)}" for _ in range(120)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words).upper().replace("W", "w"))]
        for j in range(2, 6):  # copies with one word of 120 changed: similarity about 0.92
            copy = list(words)
            copy[r.randint(0, 119)] = "changed"
            rows.append((10 * k + j, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "short"), (903, "short"), (904, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash_wide.near_copy_groups(docs).collect()}
    right = [got[i] == 10 * (i // 10) for i, _ in rows if i < 900]
    assert sum(right) >= 0.97 * len(right)
    assert got[900] == got[901] == 900 and got[902] == got[903] == 902 and got[904] == 904
    assert simhash_wide.near_copy_groups(docs.limit(0)).count() == 0
    assert all(got[i] // 10 == i // 10 for i, _ in rows if i < 900)


def test_wide_simhash_nominates(spark, monkeypatch):
    """The index of positional bytes connects what is within three bits, all pairs considered, and its links that are similar hold without the second index."""
    rng = np.random.default_rng(14)
    fps = []
    for base in rng.integers(-(2**63), 2**63, 30):
        fps += [int(base)] * 2
        for _ in range(6):
            fps.append(int(np.int64(base) ^ np.bitwise_xor.reduce(np.int64(1) << rng.choice(62, rng.integers(1, 6), replace=False))))
    nodes = spark.createDataFrame([(i, 9, fp) for i, fp in enumerate(fps)] + [(1000, 0, fps[0])], "node long, size long, fp long")
    group = list(range(len(fps)))

    def join(pairs):
        of = list(group)
        for i, j in pairs:
            a, b = sorted((of[i], of[j]))
            of = [a if x == b else x for x in of]
        return of

    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 3]
    assert join([(r.u, r.v) for r in simhash_wide.within_bits(nodes).collect()]) == join(near)

    r = random.Random(15)
    rows, other = [], []
    for k in range(12):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(700)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
        other += [f"x{k}", words[0]]
    rows += [(100, None), (101, " ".join(other))]
    assert simhash_wide.majority_bits(simhash_wide.shingle_hashes("a b c")) % 2**64 == plain_fingerprint("a b c")
    monkeypatch.setattr(simhash_wide, "bands", lambda least: np.zeros(0, np.int64))
    got = {x.doc_id: x.component_id for x in simhash_wide.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(12)) >= 10 and got[100] == 100 and got[101] == 101


def test_wide_groups_at_the_bound(spark):
    """Pairs at and just above 0.8 are grouped, and pairs just below it are not."""
    r = random.Random(11)
    rows, pairs = [], []

    def add(words, copy, near):
        pairs.append((len(rows), near))
        rows.extend([(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))])

    for _ in range(60):
        for size, near in ((204, True), (203, False)):  # 200 and 199 of 250 shingles
            words = [f"w{r.randint(0, 10**6)}" for _ in range(254)]
            add(words[:size], words, near)
        for changed, near in ((4, True), (5, False)):  # 180 of 220 and 175 of 225
            words = [f"w{r.randint(0, 10**6)}" for _ in range(204)]
            copy = list(words)
            for k in range(changed):
                copy[20 + 30 * k] = "changed"
            add(words, copy, near)
    got = {x.doc_id: x.component_id for x in simhash_wide.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[i] == got[i + 1]) == near for i, near in pairs)


def test_wide_groups_against_all_pairs(spark):
    r = random.Random(12)
    texts = []
    for _ in range(25):
        words = [f"w{r.randint(0, 300)}" for _ in range(150)]
        for _ in range(8):
            copy = list(words)
            for _ in range(r.randint(0, 6)):
                copy[r.randint(0, 149)] = f"x{r.randint(0, 300)}"
            texts.append(" ".join(copy))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    got = {x.doc_id: x.component_id for x in simhash_wide.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == group


def test_wide_positional_bytes():
    """Pairs at 0.8 pass the count of equal bytes but for a chance of 1e-5, and most of those at 0.7 don't."""
    for union in (5, 10, 50, 200, 330, 700, 3000):
        for filled in sorted({min(union, 3), min(union, 20), min(union, 120), round(128 * (1 - (1 - 1 / 128) ** union)), round(512 * (1 - (1 - 1 / 512) ** union)), min(union, 512)}):
            both = union * 4 // 5
            least = float(simhash_wide.least_equal(np.array([filled]), np.array([union + both]))[0])
            under = sum(math.comb(both, k) * math.comb(union - both, filled - k) for k in range(filled + 1) if k < least)
            assert under / math.comb(union, filled) < 1e-5
    r = np.random.default_rng(3)
    for similarity in (0.8, 0.7):
        both = int(400 * similarity)
        rows = []
        for _ in range(300):
            h = r.integers(0, 2**64, 400, np.uint64)
            one, other = np.sort(h[: both + (400 - both) // 2]), np.sort(np.concatenate([h[:both], h[both + (400 - both) // 2 :]]))
            rows.append((simhash_wide.binned(one), simhash_wide.binned(other)))
        a, b = (np.array(x) for x in zip(*rows))
        share = simhash_wide.likely(a, b, np.full(300, 400 + both)).mean()
        assert share == 1 if similarity == 0.8 else share < 0.2
    assert not simhash_wide.binned(np.zeros(0, np.uint64)).any()


def test_wide_shingles_of_long_texts():
    words = [f"w{i % 70001}" for i in range(140_000)]
    text = " \t".join(words).upper()
    plain = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), simhash_wide.SEED) for i in range(len(words) - 4)}
    assert simhash_wide.shingle_hashes(text).tolist() == sorted(plain)
    assert len(simhash_wide.shingle_hashes("a b")) == 1 and len(simhash_wide.shingle_hashes(" \n")) == len(simhash_wide.shingle_hashes(None)) == 0
