"""The pipeline stage by stage against plain code on a small table."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tilework.llm import common  # noqa: E402

SF = "/root/testdata/sf0.001"


def similar(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, now, seen = docs.columns, docs, []
    for name, stage in pipeline.STAGES:
        out = common.written(stage(spark, now, SF), name)
        seen.append((name, now, out))
        now = out
    assert [s[0] for s in seen] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert all(s[2].columns == columns for s in seen[:-1])
    toxic, lines, near, mixed, packed = (s[2].toPandas() for s in seen)
    assert set(toxic.doc_id) <= set(docs.toPandas().doc_id) and len(lines) == len(toxic)
    # Every line left was there before, in order.
    before = dict(zip(toxic.doc_id, toxic.text))
    for i, t in zip(lines.doc_id, lines.text):
        rest = iter((before[i] or "").split("\n"))
        assert t is None or all(x in rest for x in t.split("\n") if t)
    # One document of each group of copies stays, and no other goes.
    kept, text = set(near.doc_id), dict(zip(lines.doc_id, lines.text))
    shingles = {i: similar(t) for i, t in text.items()}
    for i in sorted(set(text) - kept):
        assert any(jaccard(shingles[i], shingles[j]) >= 0.8 for j in text if j != i)
    twins = [(i, j) for i in kept for j in kept if i < j and jaccard(shingles[i], shingles[j]) >= 0.8]
    assert not twins
    assert abs(mixed.text.fillna("").str.split().str.len().sum() - near.text.fillna("").str.split().str.len().sum()) <= near.source.nunique()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(mixed.doc_id)


def test_whole_run(spark):
    assert pipeline.run(spark, SF).count() > 0
