import hashlib
import random
import re

from tilework.llm import exact

BLANK = re.compile(r"[\x20\x09-\x0D]")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_against_plain_grouping(spark):
    r = random.Random(2)
    texts = ["", None, " \t\n\x0b\x0c\r", "a b", "ab", "a b", "a b", "\U0001f600 x", "\U0001f600x", "\x1c", "é", "é", "word " * 50_000]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(1000 + i, "hot  text" if i % 3 else "hot text") for i in range(900)] + [(5000 + i, f"one {i}") for i in range(300)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (None, "hot text"), (9000, "no id")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = plain(rows)
    for counters in (exact.COUNTERS, 16, 2):
        got = exact.exact_groups(docs, counters=counters).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_frequent_values_are_named(spark):
    keys = spark.range(20_000).selectExpr("case when id % 3 = 0 then -1 when id % 50 = 1 then -2 else id end as head")
    named = {x.head for x in exact.frequent(keys, "head", 256).collect()}
    assert {-1, -2} <= named and len(named) <= 128
    assert exact.frequent(keys.where("head = 77777"), "head", 256).count() == 0


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a  b", 6, "y"), (3, None, 7, "z"), (4, "", 8, "w")], "doc_id long, text string, n int, digest string")
    out = exact.exact_dedup(docs)
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == [2, 3]
    assert exact.exact_groups(docs.limit(0)).count() == 0 and exact.exact_dedup(docs.limit(0)).count() == 0


def test_no_python_and_no_text_in_shuffles(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text" not in plan
