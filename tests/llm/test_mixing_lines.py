import random
import re

import pytest

from tilework.llm import lines, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, total):
    """Plain repeated clamping."""
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        target = {s: left * weights[s] / w for s in free} if w else {}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_against_plain_clamping(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["a", "b", "B", "é", None, *(["hot"] * 9)])) for i in range(300)]
    rows += [(1000, None, "tiny"), (1001, "x\x0by z", "tiny"), (5, "again", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    want = water_fill(sizes, weights, sum(sizes.values()))
    taken = {}
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()), key=str)


def test_mix_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 9), (2, "e", "t", 9), (3, None, "u", 9)], "doc_id long, text string, source string, taken int")
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_lines(spark):
    shared, item = "Share this page with friends", "Item {} costs {} dollars today only"
    own = ["early birds sing over there", "nobody knew what came after", "she left before it rained", "green hills roll far away", "ten men went fishing once"]
    texts = [f"{own[i]}\n{shared}\n" + item.format(i, i * 7) for i in range(5)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(9, None, 9), (10, "", 9), (11, f" {shared}\t", 9), (12, "Same\nSame\nSame", 9)], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in lines.line_dedup(docs).collect()}
    assert got[0].text == texts[0] and got[0].n_dropped == 0
    assert got[1].text == own[1] and got[1].n_dropped == 2 and got[1].n_lines == 3
    assert got[9].text is None and got[10].text == "" and got[11].text == "" and got[12].text == "Same\nSame\nSame"
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_template_with_a_variable_word(spark):
    texts = [f"Dear valued customer {name} your parcel is ready for you now" for name in ("ann", "bob", "cid", "dan")] + ["Dear valued customer eve what do we say to that"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.line_dedup(docs).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: "", 4: texts[4]}


def test_two_families_in_a_leaf(spark):
    one, two = "Dear valued customer {} your parcel is ready for you now", "Dear valued customer {} thanks to all who came here today"
    assert len(one.split()) == len(two.split())
    for names in (["ann", "bob", "cid", "dan", "eve"], ["ann", "ann", "bob", "bob", "cid"]):
        texts = [f.format(x) for f in (one, two) for x in names]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in lines.line_dedup(docs).collect()}
        dropped = {i for i, t in got.items() if not t}
        assert dropped == {1, 2, 3, 4, 6, 7, 8, 9}


def test_every_pair_of_values_is_new(spark):
    """Values that recur in a field do not hide that their combinations share a template."""
    texts = [f"please come by and see us {a} on {b} next week" for a in ("early", "late", "soon") for b in ("monday", "friday", "sunday")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in lines.line_dedup(docs).orderBy("doc_id").collect() if r.text] == [0]


def test_values_of_other_families_hide_no_template(spark):
    """A family's variable word, frequent in the rest of its leaf, is still variable."""
    family = [f"Please note the parcel colour is {c} and it waits here" for c in ("red", "blue", "green", "gold")]
    other = [f"Please note the {a} {b} {c} {('red', 'blue', 'green', 'gold')[i % 4]} {a}x {b}x {c}x end" for i in range(40) for a, b, c in [[f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in "pqr"]]]
    assert {len(t.split()) for t in family + other} == {11}
    for mine in (family, family * 2):
        for more in ([], other):
            docs = spark.createDataFrame(list(enumerate(mine + more)), "doc_id long, text string")
            got = {r.doc_id for r in lines.line_dedup(docs).collect() if not r.text}
            assert got == set(range(1, len(mine)))


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "one line that all of them have", i, "k", 7, "r") for i in range(4)], "doc_id long, text string, gone int, text_key string, line long, row string")
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, "" if i else "one line that all of them have", i, "k", 7, "r", 1, int(i > 0)) for i in range(4)]


def test_hot_line_and_long_text(spark):
    docs = spark.createDataFrame([(i, "the very same old line\n" + "z" * (200_000 if i == 7 else 1)) for i in range(200)], "doc_id long, text string")
    got = lines.line_dedup(docs).collect()
    assert sum(r.n_dropped for r in got) == 199 and max(len(r.text) for r in got) == 200_000


def test_several_templates_and_a_hot_line_in_a_leaf(spark):
    """Three sorts of lines with the same number of tokens and first tokens."""
    one, two, hot = "please note that parcel from {} waits in the hall", "please note that all trains to {} leave very late", "please note that we are closed on every sunday now"
    assert len(one.split()) == len(two.split()) == len(hot.split()) == 10
    names = ["ann", "bob", "cid", "dan", "eve"]
    texts = [one.format(n) for n in names] + [two.format(n) for n in names]
    for more in ([], [hot] * 30):
        docs = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in lines.line_dedup(docs).collect()}
        assert {i: t for i, t in got.items() if t} == {i: (texts + more)[i] for i in ([0, 5, 10] if more else [0, 5])}


def test_long_line_in_two_documents(spark):
    from corpus_pipeline import lines as stage

    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    docs = spark.createDataFrame([(1, long), (2, f"before\n{long}\nafter"), (3, "a short line here"), (4, "a short line here")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in stage(spark, docs, "").collect()} == {1: long, 2: "before\nafter", 3: "a short line here", 4: "a short line here"}
    assert lines.line_dedup(docs.limit(0)).count() == 0
