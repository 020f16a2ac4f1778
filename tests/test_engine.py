"""Index, store, sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from textruns.functions.kernels import STRATEGIES, Strategy
from textruns.operators import construct as c
from textruns.operators import navigate as nav
from textruns.operators import search, stats
from textruns.plans.build import relations
from textruns.plans.index import TextIndex, register_strategy
from textruns.plans.store import Store
from textruns.sources import texts as src
from textruns.streaming import patterns as stream


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, b"abcabcababc"), (2, b"alabaralaalabarda"), (3, b""), (4, None), (5, "ñandú ñ".encode()), (6, b"a")]
    return spark.createDataFrame(rows, "text_id long, body binary")


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [(1, b"ab"), (2, b"aba"), (3, b"bc"), (4, b""), (5, None), (6, b"zz"), (7, "ñ".encode()), (8, b"a")]
    return spark.createDataFrame(rows, "pattern_id long, pattern binary")


WANT = {(1, 1, p) for p in (0, 3, 6, 8)} | {(1, 2, 6)} | {(1, 3, p) for p in (1, 4, 9)} | {(1, 8, p) for p in (0, 3, 6, 8)}
WANT |= {(2, 1, p) for p in (2, 11)} | {(2, 2, p) for p in (2, 11)} | {(2, 8, p) for p in (0, 2, 4, 6, 8, 9, 11, 13, 16)} | {(5, 7, 0), (5, 7, 8), (5, 8, 2), (6, 8, 0)}


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("s", [1, 4])
def test_save_load_locate(spark, texts, patterns, tmp_path, s):
    TextIndex.build(texts, s).save(str(tmp_path / "index"))
    index = TextIndex.load(spark, str(tmp_path / "index"))
    assert {r["s"] for r in index.data.select("s").collect()} == {s}
    for name in STRATEGIES:
        found = rows(index.locate(patterns, name))
        assert len(found) == len(set(found)) and set(found) == WANT, name
    assert {(t, p): n for t, p, n, *_ in rows(index.count(patterns))}[2, 8] == 9
    assert index.sizes().count() > 0 and index.counters().count() == 5


def test_scan_agrees(texts, patterns):
    index = TextIndex.build(texts)
    assert set(rows(search.scan_locate(texts, patterns))) == set(rows(index.locate(patterns)))
    assert set(rows(search.scan_count(texts, patterns))) == {r[:3] for r in rows(index.count(patterns))}


def test_empty_tables(spark, texts, patterns):
    none, nothing = texts.limit(0), patterns.limit(0)
    assert TextIndex.build(none).locate(patterns).count() == 0
    assert TextIndex.build(texts).locate(nothing).count() == 0
    assert c.bwt_runs(c.bwt(c.suffix_array(none))).count() == 0


def test_errors(texts, spark, patterns):
    with pytest.raises(ValueError):
        TextIndex.build(texts, 0)
    with pytest.raises(ValueError):
        TextIndex.build(texts).locate(patterns, "none such")
    with pytest.raises(Exception, match="NUL"):
        TextIndex.build(spark.createDataFrame([(1, b"a\0b")], "text_id long, body binary")).data.collect()


def test_lean_index(texts, patterns):
    lean = TextIndex.build(texts, 4, False, False)
    assert set(rows(lean.locate(patterns, "heads"))) == set(rows(lean.locate(patterns, "tails"))) == WANT and lean.count(patterns).count() > 0
    for strategy in ("sa_slice", "heads_sampled"):
        with pytest.raises(Exception, match="built without"):
            lean.locate(patterns, strategy).collect()


def test_own_strategy(texts, patterns):
    register_strategy(Strategy("mine", backward=False, sampled=True, valid_mark=True))
    try:
        assert set(rows(TextIndex.build(texts).locate(patterns, "mine"))) == set(rows(TextIndex.build(texts).locate(patterns)))
    finally:
        del STRATEGIES["mine"]


def test_store_builds_once(spark, texts, tmp_path):
    store = Store(spark, str(tmp_path))
    made = relations(store, texts)
    assert made["links_forward"].where("text_id = 2").orderBy("mark").select("sample_prun").toPandas()["sample_prun"].tolist() == [9, 3, 8, 4, 6, 5, 0, 7, 2, 1]
    again = Store(spark, str(tmp_path))
    assert again.has("runs") and again.once("runs", lambda: 1 / 0).count() == made["runs"].count()
    with pytest.raises(KeyError):
        again.get("none such")
    got = {r["mark"]: (r["valid"], r["area"]) for r in made["validity_forward"].where("text_id = 1").collect()}
    assert {k: v[1] for k, v in got.items()} == {0: None, 2: 1, 5: None, 11: 4}


def test_asof(spark):
    table = spark.createDataFrame([(1, 2, "a"), (1, 6, "b"), (2, 4, "c")], "g long, k long, x string")
    probes = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (1, 6), (2, 9), (3, 1)], "g long, v long")

    def run(**kw):
        return {(r["g"], r["v"]): r["x"] for r in nav.asof(probes, table, ["g"], "v", "k", ["x"], **kw).collect()}

    assert run() == {(1, 1): None, (1, 2): "a", (1, 5): "a", (1, 6): "b", (2, 9): "c", (3, 1): None}
    assert run(strict=True) == {(1, 1): None, (1, 2): None, (1, 5): "a", (1, 6): "a", (2, 9): "c", (3, 1): None}
    assert run(backward=False) == {(1, 1): "a", (1, 2): "a", (1, 5): "b", (1, 6): "b", (2, 9): None, (3, 1): None}
    assert run(backward=False, strict=True) == {(1, 1): "a", (1, 2): "b", (1, 5): "b", (1, 6): None, (2, 9): None, (3, 1): None}


def test_circular_neighbours(spark):
    marks = spark.createDataFrame([(1, m) for m in (2, 6, 7, 9, 10, 11)], "text_id long, mark long")
    probes = spark.createDataFrame([(1, v) for v in (0, 2, 3, 6, 7, 8, 9, 11, 12)], "text_id long, v long")
    down = {r["v"]: (r["order"], r["mark"]) for r in nav.predecessor(marks, probes).collect()}
    up = {r["v"]: (r["order"], r["mark"]) for r in nav.successor(marks, probes).collect()}
    assert down == {0: (5, 11), 2: (5, 11), 3: (0, 2), 6: (0, 2), 7: (1, 6), 8: (2, 7), 9: (2, 7), 11: (4, 10), 12: (5, 11)}
    assert up == {0: (0, 2), 2: (0, 2), 3: (1, 6), 6: (1, 6), 7: (2, 7), 8: (3, 9), 9: (3, 9), 11: (5, 11), 12: (0, 2)}


def test_lf_ranges(spark, texts):
    one = texts.where("text_id = 1")
    sa = c.suffix_array(one)
    runs2, alpha = c.ordered_runs(c.bwt_runs(c.bwt(sa))), c.alphabet(c.bwt(sa))
    given = [(0, 12, "\0", 0, 1), (0, 12, "a", 1, 5), (0, 12, "b", 5, 9), (0, 12, "c", 9, 12), (1, 5, "c", 10, 12), (1, 5, "b", 5, 6), (10, 12, "b", 7, 9), (1, 9, "b", 5, 6), (9, 12, "b", 6, 9), (1, 5, "a", 1, 1)]
    ranges = spark.createDataFrame([(1, lo, hi, ord(s)) for lo, hi, s, *_ in given], "text_id long, lo long, hi long, sym int")
    got = {(r["lo"], r["hi"], chr(r["sym"])): (r["new_lo"], r["new_hi"]) for r in nav.lf_range(runs2, alpha, ranges).collect()}
    assert got == {(lo, hi, s): (a, b) for lo, hi, s, a, b in given}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.txt").write_text("YWI=\n\nYg==\n")
    read = src.read_patterns(spark, str(tmp_path / "p.txt"), base64=True)
    assert sorted(bytes(r["pattern"]) for r in read.collect()) == [b"ab", b"b"]
    assert sorted(r["encoded"] for r in src.encode_patterns(read.select("pattern_id", "pattern")).collect()) == ["YWI=", "Yg=="]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.bin").write_bytes(b"abab")
    texts = src.read_files(spark, str(tmp_path / "texts"))
    index = TextIndex.build(texts)
    src.write_locate(index.locate(read), read, str(tmp_path / "out"), encoded=True)
    lines = sorted(r["value"].split()[0] + ":" + " ".join(r["value"].split()[2:]) for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["YWI=:0 2", "Yg==:1 3"]
    src.write_count(index.count(read), read, str(tmp_path / "counts"))
    counts = spark.read.csv(str(tmp_path / "counts"), header=True)
    assert counts.columns == ["pattern", "text_id", "count", "range_start", "range_end"]
    assert sorted((r["pattern"], r["count"], r["range_start"], r["range_end"]) for r in counts.collect()) == [("ab", "2", "1", "3"), ("b", "2", "3", "5")]


def test_ids_null_repeated_and_of_other_types(spark):
    rows = [(None, "abab"), (1, "abab"), (1, "abab"), (2, None)]
    texts = src.texts_of(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    asked = spark.createDataFrame([(7, b"ab")], "pattern_id long, pattern binary")
    want = sorted(map(str, rows_of := [tuple(r) for r in search.scan_locate(texts, asked).collect()]))
    assert len(rows_of) == 6
    for name in STRATEGIES:
        assert sorted(map(str, (tuple(r) for r in TextIndex.build(texts).locate(asked, name).collect()))) == want, name
    with pytest.raises(ValueError, match="NULL or stands"):
        src.with_distinct_ids(texts)
    named = src.texts_of(spark.createDataFrame([("x", "abab"), (None, "ab")], "k string, t string"), "k", "t")
    assert sorted((r["text_id"] is None, r["pos"]) for r in TextIndex.build(named).locate(asked).collect()) == [(False, 0), (False, 2), (True, 0)]


@pytest.mark.parametrize("algorithm", c.ALGORITHMS)
def test_suffix_arrays_of_repetitive_texts(spark, algorithm):
    bodies = [b"ab" * 60, b"a" * 40, b"", b"abcabcababc" * 9, bytes(range(1, 90))]
    texts = spark.createDataFrame(list(enumerate(bodies)), "text_id long, body binary")
    got = {}
    for r in c.suffix_array_by(texts, algorithm).collect():
        got[r["text_id"], r["i"]] = r["sa"]
    assert got == {(t, i): p for t, x in enumerate(bodies) for i, p in enumerate(sorted(range(len(x) + 1), key=lambda p: x[p:]))}
    with pytest.raises(ValueError, match="unknown algorithm"):
        c.suffix_array_by(texts, "none such")


@pytest.mark.parametrize("strategy", ["sa_slice", "tails", "tails_sampled_areas", "heads_sampled", "heads_psi_sampled_marks"])
def test_chains_of_strategies(spark, texts, tmp_path, strategy):
    made = relations(Store(spark, str(tmp_path)), texts.where("body IS NOT NULL"), strategy=strategy)
    how = STRATEGIES[strategy]
    side = "backward" if how.backward else "forward"
    assert ("runs" in made) == (not how.slice) and (f"samples_{side}" in made) == how.sampled and (f"validity_{side}" in made) == how.valid_mark
    assert ("psi" in made) == (not how.backward) and (f"mark_links_{side}" in made) == (how.sampled and how.psi_order)
    assert all(df.count() > 0 for df in made.values())


def test_nul_and_collection(spark):
    df = spark.createDataFrame([(1, b"a\0b"), (2, b"ab"), (3, b"")], "text_id long, body binary")
    assert {r["text_id"] for r in src.without_nul(df).collect()} == {2, 3}
    assert {r["text_id"]: bytes(r["body"]) for r in src.without_nul(df, b"\x02").collect()}[1] == b"a\x02b"
    one, offsets = src.collection(src.without_nul(df))
    assert bytes(one.first()["body"]) == b"ab\x01\x01" and {r["text_id"]: r["start"] for r in offsets.collect()} == {2: 0, 3: 3}
    found = TextIndex.build(one).locate(spark.createDataFrame([(1, b"b")], "pattern_id long, pattern binary"))
    placed = nav.asof(found.select(F.lit(0).alias("g"), "pos"), offsets.select(F.lit(0).alias("g"), "start", F.col("text_id").alias("doc")), ["g"], "pos", "start", ["doc"])
    assert [(r["doc"], r["pos"] - r["start"]) for r in placed.collect()] == [(2, 1)]


def test_statistics(spark):
    times = spark.createDataFrame([("r/4", 1.0), ("r/4", 3.0)], "name string, seconds double")
    r = stats.timing_summary(times).first()
    assert (r["repetitions"], r["least"], r["most"], r["total"], r["median"]) == (2, 1.0, 3.0, 4.0, 2.0)
    plot = stats.query_plot(times.withColumn("bits", F.lit(2.0)), spark.createDataFrame([("r", "R")], "name string, label string"))
    assert plot.first().asDict() == {"label": "R", "ms": 1000.0, "bits": 2.0}


def test_query_plot_joins_all_labels(spark):
    names = spark.range(20_000).select(F.col("id").cast("string").alias("name"))
    rows = names.select(F.concat("name", F.lit("/4")).alias("name"), F.lit(1.0).alias("seconds"), F.lit(2.0).alias("bits"))
    assert stats.query_plot(rows, names.withColumn("label", F.col("name"))).count() == 20_000


def test_streams(spark, texts, patterns, tmp_path):
    patterns.where("pattern_id < 4").write.parquet(str(tmp_path / "in"))
    given = spark.readStream.schema("pattern_id long, pattern binary").parquet(str(tmp_path / "in"))
    got = []
    q = stream.locate_stream(TextIndex.build(texts), given, lambda df, n: got.extend(rows(df)), checkpoint=str(tmp_path / "check"))
    q.awaitTermination(120)
    assert set(got) == {x for x in WANT if x[1] < 4}
    texts.write.parquet(str(tmp_path / "texts"))
    live = spark.readStream.schema("text_id long, body binary").parquet(str(tmp_path / "texts"))
    w = stream.count_in_stream(live, [(1, b"ab")]).writeStream.format("memory").queryName("counts").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {(1, 1, 4), (2, 1, 2)}


def test_command_line(spark, tmp_path):
    from textruns.__main__ import main

    spark.createDataFrame([(1, "abcabcababc"), (2, "xyz")], "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    (tmp_path / "p.txt").write_text("ab\nz\n")
    main(["build", "--data", str(tmp_path / "texts"), "--out", str(tmp_path / "index"), "--rate", "4"])
    for what, more in (("count", []), ("locate", ["--strategy", "heads_psi_sampled_areas"])):
        main([what, "--index", str(tmp_path / "index"), "--patterns", str(tmp_path / "p.txt"), "--out", str(tmp_path / what), *more])
    assert sorted((r["pattern"], r["count"]) for r in spark.read.csv(str(tmp_path / "count"), header=True).collect()) == [("ab", "4"), ("z", "1")]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "locate")).collect()) == ["ab 1 0 3 6 8", "z 2 2"]
    for mode, n in (("macro", 2), ("micro", 2), ("print", 1)):
        main(["bench", "--index", str(tmp_path / "index"), "--patterns", str(tmp_path / "p.txt"), "--out", str(tmp_path / mode), "--mode", mode, "--reps", "2", "--strategy", "tails"])
        times = spark.read.csv(str(tmp_path / mode / "times"), header=True, inferSchema=True).collect()
        assert len(times) == n and all(r["name"] == "tails/4" and r["seconds"] > 0 and r["bits"] > 0 for r in times)
        assert sorted(r["occurrences"] for r in times) == ([1, 4] if mode == "micro" else [5] * n)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "print" / "tails")).collect()) == ["ab 1 0 3 6 8", "z 2 2"]
    main(["bench", "--index", str(tmp_path / "index"), "--patterns", str(tmp_path / "p.txt"), "--out", str(tmp_path / "stats"), "--reps", "3", "--min-time", "0.1", "--strategy", "heads", "--report-stats"])
    summed = spark.read.csv(str(tmp_path / "stats" / "times"), header=True, inferSchema=True).first()
    assert summed["repetitions"] == 3 and 0 < summed["least"] <= summed["median"] <= summed["most"]
    main(["relations", "--data", str(tmp_path / "texts"), "--out", str(tmp_path / "relations"), "--rate", "4", "--strategy", "heads_slim_sampled", "--algorithm", "blocks"])
    log = spark.read.csv(str(tmp_path / "relations" / "log"), header=True, inferSchema=True).collect()
    assert {r["relation"] for r in log} == {"suffix_array_blocks", "runs", "alphabet", "psi", "links_forward", "s=4/samples_forward", "s=4/places_forward", "s=4/marks_forward", "s=4/mark_links_forward"}
    assert all(r["bytes"] > 0 and r["seconds"] > 0 for r in log)
    main(["sweep", "--data", str(tmp_path / "texts"), "--out", str(tmp_path / "sweep"), "--max-rate", "8"])
    assert spark.read.parquet(str(tmp_path / "sweep")).count() == 4


def test_binary_files(spark, tmp_path):
    import numpy as np

    from textruns.sources import binary

    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "x.ssa").write_bytes(b"".join(v.to_bytes(5, "little") for v in (0, 11, 2, 0, 3, 2**33)))
    assert [(r["run"], r["row"], r["text_pos"]) for r in binary.read_pairs(spark, str(tmp_path / "pairs"), 12).orderBy("run").collect()] == [(0, 0, 10), (1, 2, 11), (2, 3, (2**33 - 1) % 12)]
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 2**40), (1, 2, 0)], "k long, i long, v long")
    content = bytes(binary.as_u64(rows, "k", "i", "v").first()["content"])
    assert np.frombuffer(content, "<i8").tolist() == [5, 2**40, 0]
    (tmp_path / "u64").mkdir()
    (tmp_path / "u64" / "a").write_bytes(content)
    assert [r["value"] for r in binary.read_u64(spark, str(tmp_path / "u64")).orderBy("i").collect()] == [5, 2**40, 0]
