import random

from pyspark.sql import functions as F

from tilework.functions import columns as C
from tilework.functions import sequences as S
from tilework.operators import containment, summaries, tiles
from tilework.sources import readers, writers


def value(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_parsing(spark):
    base, tile = C.tile_parts(F.lit("human_X_tile_3_tile_12"))
    none, no_tile = C.tile_parts(F.lit("abc"))
    got = value(spark, b=base, t=tile, n=none, m=no_tile, f=C.safe_double(F.lit("x")), s=C.strip(F.lit("\t a b \n")), g=C.gc_fraction(F.lit("GCAT")), e=C.gc_fraction(F.lit("")))
    assert (got.b, got.t, got.n, got.m, got.f, got.s, got.g, got.e) == ("human_X_tile_3", 12, None, None, None, "a b", 0.5, None)
    got = value(spark, a=C.category(F.lit("random_1")), b=C.category(F.lit("human_q")), c=C.category(F.lit("zika")), d=C.category(F.lit(None).cast("string")), e=C.two_groups(F.lit("random_1")))
    assert tuple(got) == ("random", "human_TF", "virus", "NA", "virus")
    z, n = F.lit(0.0), F.lit(None).cast("double")
    got = value(spark, a=C.fallback_score(z, F.lit(2.0)), b=C.fallback_score(z, F.lit(2.0), "null_missing"), c=C.fallback_score(n, n), d=C.admission_status(n, F.lit(1.0)))
    assert tuple(got) == (2.0, 0.0, 0.0, "admitted_single_label")


def test_sequences(spark):
    got = value(spark, r=S.reverse_complement(F.lit("ACNGT")), n=S.normal(F.lit("acgu")), o=S.overlap(F.lit("ACGTAC"), F.lit("TACGG"), 30), z=S.overlap(F.lit("AAAA"), F.lit("CCCC"), 30), c=S.occurrences(F.lit("AAAA"), "AA"))
    assert tuple(got) == ("ACNGT", "ACGT", 3, 0, 2)
    strict, lenient = (value(spark, h=S.one_hot(F.lit("AcNu"), 5, x)).h for x in (False, True))
    assert strict == [1, 0, 0, 0] + [0] * 16
    assert lenient == [1, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0]


def test_contains_join_against_brute_force(spark):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("ACGT") for _ in range(r.choice([5, 40, 1500])))) for i in range(20)]
    patterns = [(j, t[p : p + 12]) for j, (_, t) in enumerate(texts) if len(t) > 30 for p in [len(t) - 15]] + [(99, "ACGTACGTACGTA")]
    got = {(x.pattern_id, x.seq_id): x.pos for x in containment.contains_join(spark.createDataFrame(texts, "seq_id long, sequence string"), spark.createDataFrame(patterns, "pattern_id long, pattern string")).collect()}
    assert got == {(j, i): t.find(p) for j, p in patterns for i, t in texts if p in t}


def test_patterns_of_all_lengths(spark):
    """One letter to longer than a piece, in texts from empty to longer than a block, letters of other planes included."""
    r = random.Random(7)
    draw = lambda n: "".join(r.choice("AC\U0001f600é") for _ in range(n))
    texts = [(i, draw(n)) for i, n in enumerate([0, 1, 2, 3, 7, 31, 32, 33, 400, 3000, 3000])] + [(50, None), (51, "AC" * 600_000 + "é" + "CA" * 30), (52, "A" * 2000)]
    patterns = [(0, ""), (1, None), (2, "A"), (3, "é"), (4, "AA"), (5, "ZZ"), (6, "C" + "A" * 40), (7, "AC" * 20 + "é" + "CA" * 20), (8, "A" * 2000), (9, "A" * 1999)]
    patterns += [(100 + 10 * i + n, t[p : p + n]) for i, t in texts[8:11] for n in (2, 3, 5, 8) for p in [len(t) // 2]]
    patterns += [(1000 + n, texts[9][1][5 : 5 + n]) for n in (15, 16, 17, 31, 32, 33, 64, 1024, 1025, 2500)] + [(2000, texts[9][1][5:2000] + "Z")]
    got = {(x.pattern_id, x.seq_id): x.pos for x in containment.contains_join(spark.createDataFrame(texts, "seq_id long, sequence string"), spark.createDataFrame(patterns, "pattern_id long, pattern string")).collect()}
    assert got == {(j, i): t.find(p) for j, p in patterns for i, t in texts if p and t and p in t}


def test_longest_of_twenty_lengths(spark):
    r = random.Random(9)
    draw = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    texts = [(i, draw(r.choice([30, 300, 2000]))) for i in range(30)]
    words = [(t[p : p + n], f"{i}-{n}") for i, t in texts[:20] for n in range(3, 23) for p in [r.randint(0, len(t) - n)] if r.random() < 0.2] + [("", "none"), (None, "none")]
    got = {x.seq_id: (x.length, x.pos, x.value) for x in containment.longest_match(spark.createDataFrame(texts, "seq_id long, sequence string"), spark.createDataFrame(words, "key string, value string")).collect()}
    for i, t in texts:
        hits = sorted((-len(k), t.find(k), v) for k, v in words if k and k in t)
        assert got[i] == ((-hits[0][0], hits[0][1], hits[0][2]) if hits else (None, None, None))


def test_sources_keep_apart(spark):
    rows = [("r1", "s", "ACGTT"), ("r2", "s", "AACGT"), ("r3", "t", "ACGTT"), ("r4", None, "ACGTT"), ("r5", "s", "GGGGG")]
    rec = spark.createDataFrame(rows, "record_id string, source string, trigger string")
    ref = spark.createDataFrame([("s", "b", "CCACGTTC"), ("s", "a", "GACGTTACGTT"), ("t", "c", "CCCCC"), (None, "d", "ACGTT")], "source string, accession string, sequence string")
    got = {r.record_id: (r.source_accession, r.window_start, r.window_end, r.strand) for r in containment.locate_in_source(rec, ref).collect()}
    assert got == {"r1": ("a", 2, 6, "+"), "r2": ("a", 2, 6, "-")}
    rates = {(r.source, r.accession): (r.n_fwd, r.n_rev, r.n) for r in containment.reference_rates(rec, ref).collect()}
    assert rates == {("s", "a"): (1, 1, 3), ("s", "b"): (1, 1, 3)}


def test_windows_longest_and_source(spark):
    texts = spark.createDataFrame([(1, "TTACGTAA"), (2, "GGGG"), (3, None)], "seq_id long, sequence string")
    words = spark.createDataFrame([("ACG", "x"), ("TACGT", "y"), ("CGT", "z")], "key string, value string")
    got = {r.seq_id: (r.length, r.pos, r.value) for r in containment.longest_match(texts, words).collect()}
    assert got == {1: (5, 1, "y"), 2: (None, None, None), 3: (None, None, None)}
    hit = containment.window_lookup(texts, words.where("length(key) = 3")).first()
    assert (hit.seq_id, hit.pos, hit.strand, hit["values"]) == (1, 2, "forward", ["x"])
    rec = spark.createDataFrame([("r1", "s", "ACG"), ("r2", "s", "TTTT"), ("r3", "s", "")], "record_id string, source string, trigger string")
    ref = spark.createDataFrame([("s", "acc", "CCCACGAAAAC")], "source string, accession string, sequence string")
    got = {r.record_id: (r.window_start, r.window_end, r.strand) for r in containment.locate_in_source(rec, ref).collect()}
    assert got == {"r1": (4, 6, "+"), "r2": (7, 10, "-")}
    first = containment.dictionary(spark.createDataFrame([("k", "late", 2, 0), ("k", "on", 1, 0), ("k", "off", 1, 1)], "key string, value string, row_no int, side int")).first()
    assert first.value == "on"
    rates = spark.createDataFrame([("s", "b", 0.95), ("s", "a", 0.92), ("u", "c", 0.0)], "source string, accession string, rate double")
    assert {(r.source, r.accession, r.status) for r in containment.best_reference(rates).collect()} == {("s", "b", "ok"), ("u", "c", "failed")}
    assert {(r.source, r.accession) for r in containment.best_reference(rates, True).collect()} == {("s", "a"), ("u", "c")}


def test_tiles_and_components(spark):
    t = spark.createDataFrame([("t", 1, "AAAC"), ("t", 2, "AACG"), ("t", 5, "TTTT")], "target_id string, tile int, trigger string")
    assert [r.identity for r in tiles.adjacent_identity(t, length=4).orderBy("tile").collect()] == [0.75, 0.0]
    assert tiles.tiling_step(t).first().step == 1
    c = tiles.overlap_components(spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "key long, kmer string"), "key", "kmer")
    assert {r.key: r.component for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    h = {r.bin: r.n for r in summaries.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double"), "v", 2).collect()}
    assert h == {0: 1, 1: 2}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b,c\n 1 ,x,y\n2\n")
    pad = readers.ragged_csv(spark, f"{tmp_path}/r.csv", ["a", "b", "c"]).collect()
    assert [tuple(r) for r in pad] == [("1", "x", "y"), ("2", "", "")]
    assert readers.ragged_csv(spark, f"{tmp_path}/r.csv", ["a", "b", "c"], "skip").count() == 1
    (tmp_path / "s.fa").write_text(">NC_1 one\nACGU\nacg\n>NC_2 two\nTTT\n")
    assert {(r.accession, r.sequence) for r in readers.fasta(spark, f"{tmp_path}/s.fa").collect()} == {("NC_1", "ACGTACG"), ("NC_2", "TTT")}
    (tmp_path / "g.json").write_text('{"A": {"acc": "x", "status": "ok"}, "B": {"acc": "y", "status": "failed"}}')
    assert [tuple(r) for r in readers.gene_map(spark, f"{tmp_path}/g.json").collect()] == [("human_A", "x")]
    (tmp_path / "m.json").write_text('{"v": {"accessions": ["p", "q"]}}')
    assert readers.accession_map(spark, f"{tmp_path}/m.json").count() == 2
    df = spark.createDataFrame([("m", 1.0)], "method string, v double")
    writers.parquet(df, f"{tmp_path}/t/v0")
    assert writers.rewritten(spark, f"{tmp_path}/t", 0, lambda d: d.withColumn("v", F.col("v") + 1)).first().v == 2.0
    writers.metric_json(df, f"{tmp_path}/j", ["method"])
    assert writers.manifest(spark, f"{tmp_path}/j").where("length > 0").count() >= 1


def test_dictionary_values_stay_rows(spark):
    from tilework.operators import containment

    e = spark.createDataFrame([("hot", i % 50) for i in range(200)] + [("one", 7), ("none", None)], "key string, value long")
    assert {tuple(r) for r in containment.value_counts(e).collect()} == {("hot", 50), ("one", 1), ("none", 0)}
    assert containment.multi_dictionary(e).count() == 51
    assert "collect_set" not in containment.value_counts(e)._jdf.queryExecution().optimizedPlan().toString()


def test_composition_of_texts_of_no_and_of_one_letter(spark, tmp_path):
    """Query and SQL agree where there are no letters, or no two."""
    import duckdb

    from tilework.plans.queries import QUERIES, SQL

    rows = [(1, "A.", "en", "s", 2), (2, "", "en", "s", 0), (3, None, None, "s", None), (4, "12 3", "en", "s", 4), (5, "ab", "en", "s", 2), (6, "cgcgta", "en", "s", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.record_id, r.place): r.value for r in QUERIES["composition"](spark, str(tmp_path)).collect()}
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {(i, k): v for i, k, v in base.execute(SQL["composition"]).fetchall()} and len(got) == 54


def test_copies_of_a_text_meet_in_as_many_rows_as_there_are_copies(spark):
    """Triggers that records share are looked for once; places, rates and counts are those of every record by itself."""
    text = "ACGTTGCAACGGTCATTGCCATGCAATTGCGTACCGGATTACAGGCATCCTAGGATCTTAC"
    rec = spark.createDataFrame([(i, "s", text[20:50]) for i in range(40)] + [(90, "s", None), (91, "o", text[20:50])], "record_id long, source string, trigger string")
    ref = spark.createDataFrame([("s", i, text) for i in range(40)] + [("s", 50, "ACGT"), (None, 51, text)], "source string, accession long, sequence string")
    assert containment._trigger_hits(rec, ref).count() == 40
    got = containment.locate_in_source(rec, ref).collect()
    assert sorted(x.record_id for x in got) == list(range(40)) and {tuple(x)[1:] for x in got} == {(0, 21, 50, "+")}
    assert {(x.accession, x.n_fwd, x.n_rev, x.n) for x in containment.reference_rates(rec, ref).collect()} == {(i, 40, 0, 41) for i in range(40)}
