import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.llm import packing
from tilework.llm.wordbpe import load

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "don't I'M 12,5 ½ é ﬁ 日本語 😀!! x 'sx", "ΣΑΣ İstanbul a‍b ǅ ẞ they'll 'LL ٣٤ Ⅷ", "x 's's're'd !'s ''s", "a\x1cb\x85c　d", "nul\0 <|endoftext|> x", "'re", "q'll\n", None]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(PATH), [t or "" for t in ODD]
    assert [x.tolist() for x in load(PATH).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 30, 64, 2048])
    counts = {n: r.randint(1, r.choice([1, 5, 500])) for n in r.sample(range(1, capacity + 1), min(capacity, r.randint(1, 40)))}
    bins, seen = {}, set()
    for n, lo, hi, first, each, offset in packing.plan(counts, capacity):
        for k in range(lo, hi):
            assert (n, k) not in seen
            seen.add((n, k))
            bins.setdefault(first + (k - lo) // each, []).append((offset + ((k - lo) % each) * n, n))
    assert len(seen) == sum(counts.values())
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert len(bins) <= 1.5 * packing.lower_bound(counts, capacity) + 1


def test_pack_small_capacity(spark):
    texts = [*ODD, "word " * 40, "word " * 40, "one two three"]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(0, "", "extra")], "doc_id long, text string, length string")
    got = packing.best_fit_pack(docs, PATH, capacity=16).collect()
    ids = {i: np.append(x, 0).astype("<u4") for i, x in enumerate(load(PATH).encode([t or "" for t in texts]))}
    assert sorted((r.doc_id, r.piece) for r in got) == sorted([(i, k) for i, x in ids.items() for k in range(-(-len(x) // 16))] + [(0, 0)])
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == 16 * r.piece
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 16


def test_pack_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_pack(docs, PATH).count() == 0
    assert packing.best_fit_pack(docs.select("doc_id", F.col("text")), PATH).columns[:3] == ["doc_id", "piece", "start"]
