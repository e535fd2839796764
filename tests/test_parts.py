"""Sources, functions, segmentation and tests of balance, by hand-computed cases."""

import math
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from parley.functions import numbers, text
from parley.functions.ratio import matching_ratio
from parley.functions.vectors import pack, unpack
from parley.operators import segmentation
from parley.operators.balance import two_sided_binomial
from parley.plans.rankings import greedy_phrases
from parley.sources import export, ingest


def test_new_rows_keep_nulls_and_drop_repeats(spark):
    batch = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1), (None, 1)], "id long, c long")
    held = spark.createDataFrame([(2, 1)], "id long, c long")
    assert sorted(((r.id, r.c) for r in ingest.new_rows(batch, held, ["id", "c"]).collect()), key=str) == [(1, 1), (None, 1), (None, 1)]


def test_reconciliation_is_one_to_one_and_nearest_first(spark):
    imported = spark.createDataFrame([(1, "a", 100), (2, "a", 130), (3, "b", 100), (4, "a", 500)], "id long, content string, ts_sec long")
    live = spark.createDataFrame([(10, "a", 131), (11, "a", 125), (12, "b", 160), (13, "a", 441)], "live_id long, content string, ts_sec long")
    got = sorted((r.live_id, r.id, r.distance) for r in ingest.reconcile(imported, live, ["content"]).collect())
    assert got == [(10, 2, 1), (11, 1, 25), (13, 4, 59)]


def test_decoding(spark):
    rows = [(1, 1, b"plain"), (2, 1, zstandard.ZstdCompressor().compress("größer".encode())), (3, 3, b"\xff\xfe"), (4, 1, b"\x28\xb5\x2f\xfdbroken"), (5, 1, None)]
    df = spark.createDataFrame(rows, "id long, message_type int, raw binary")
    assert [r.content for r in ingest.decode_content(df).orderBy("id").collect()] == ["plain", "größer", "[image]", "[binary]", None]


def test_synthetic_messages_do_not_change(spark):
    a, b = (ingest.synthetic_messages(spark, 3, 50).orderBy("id").collect() for _ in range(2))
    assert a == b and len(a) == 150 and len({r.ts_sec for r in a if r.conversation_id == 0}) == 50


def test_exports(spark, tmp_path):
    m = ingest.synthetic_messages(spark, 2, 60).withColumn("member", F.lit(1)).withColumn("ts", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    export.write_csv(m.select("id", "content"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 120
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfid,content\n") for f in (tmp_path / "csv").glob("part-*.csv"))
    export.write_text(m, str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).where("value like '---%'").count() == m.select("conversation_id", F.to_date("ts")).distinct().count()
    assert export.radar_report("t", {"a": 50.0, "b": 120.0}).count("<tr>") == 2


def test_best_cuts_find_steps():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (20, 2)), rng.normal(3, 0.2, (15, 2)), rng.normal(-2, 0.2, (17, 2))])
    assert segmentation.best_cuts(x) == [20, 35]
    assert segmentation.best_cuts(np.ones((30, 2))) == []
    assert segmentation.best_cuts(rng.normal(0, 1, (40, 2))) == []
    assert segmentation.best_cuts(np.empty((0, 2))) == []


@pytest.mark.parametrize(("k", "n"), [(0, 5), (3, 10), (5, 10), (60, 100), (0, 0), (400, 1000)])
def test_binomial(spark, k, n):
    df = spark.createDataFrame([(k, n)], "k long, n long")
    want = min(1.0, sum(math.comb(n, i) for i in range(n + 1) if math.comb(n, i) <= math.comb(n, k)) / 2**n)
    assert two_sided_binomial(df, "k", "n").first().p_value == pytest.approx(want, rel=1e-9)


def test_greedy_phrases(spark):
    rows = [("x", "a b", 9), ("x", "a b c", 8), ("x", "d e", 7), ("x", "e", 6), ("x", "f g", 5), ("y", "z", 1)]
    got = greedy_phrases(spark.createDataFrame(rows, "lang string, phrase string, n long"), ["lang"], 3)
    assert sorted((r.lang, r.place, r.phrase) for r in got.collect()) == [("x", 0, "a b"), ("x", 1, "d e"), ("x", 2, "f g"), ("y", 0, "z")]


def test_greedy_phrases_look_beyond_the_head(spark):
    rows = [("x", "a" * i, 100 - i) for i in range(1, 40)] + [("x", "b", 1)]
    got = greedy_phrases(spark.createDataFrame(rows, "lang string, phrase string, n long"), ["lang"], 2)
    assert [r.phrase for r in got.orderBy("place").collect()] == ["a", "b"]


def test_greedy_phrases_of_rows_without_a_key(spark):
    rows = [(None, "a" * i, 100 - i) for i in range(1, 40)] + [(None, "b", 2), (None, "bc", 1), ("y", "z", 1)]
    got = greedy_phrases(spark.createDataFrame(rows, "lang string, phrase string, n long"), ["lang"], 2)
    assert sorted(((r.lang, r.place, r.phrase, r.n) for r in got.collect()), key=repr) == [("y", 0, "z", 1), (None, 0, "a", 99), (None, 1, "b", 2)]


def test_columns(spark):
    df = spark.createDataFrame([("a <msg>x</msg> [image]  b\n", [1.0, 0.0], [0.0, 0.0], 0.25)], "t string, a array<double>, z array<double>, x double")
    row = df.select(
        text.cleaned(F.col("t")).alias("c"), numbers.cosine(F.col("a"), F.col("z")).alias("none"), numbers.cosine(F.col("a"), F.col("a")).alias("one"),
        numbers.interpolated(F.col("x"), ((0.0, 10.0), (0.5, 20.0))).alias("i"), text.html_escaped(F.lit("<a & 'b'>")).alias("h"), text.clipped(F.lit("abcdef"), 3).alias("s"),
        F.array_join(text.character_grams(F.lit("abc"), 2), ",").alias("g"), F.size(text.character_grams(F.lit("a"), 2)).alias("g0"),
        matching_ratio(F.lit("abcd"), F.lit("bcde")).alias("r"), unpack(pack("a")).alias("v"), unpack(F.lit(b"no")).alias("v0"),
    ).first()
    assert (row.c, row.none, row.one, row.i, row.s, row.g, row.g0, row.r, row.v, row.v0) == ("a b", None, 1.0, 15.0, "abc…", "ab,bc", 0, 0.75, [1.0, 0.0], [])
    assert row.h == "&lt;a &amp; &#x27;b&#x27;&gt;"


def test_ratios_compare_whole_turns(spark, tmp_path):
    from parley import registry

    turns = [(1, 0, "user", "a" * 500), (1, 1, "user", "a" * 500 + "b" * 500), (1, 2, "user", "a" * 500 + "b" * 500), (1, 3, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.ratio for r in registry.queries()["str_22"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.6667, 2: 1.0, 3: None}


def test_runs_of_long_and_odd_texts(spark, tmp_path):
    from parley import registry

    long = "ab1c" * 30_000
    turns = [(1, 0, long), (1, 1, None), (1, 2, ""), (1, 3, "a"), (1, 4, "a😀b"), (1, 5, "1234567é")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    begun = time.monotonic()
    got = {r.turn: (r.shared, r.keeps_core) for r in registry.queries()["rul_18"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, True), 1: (None, None), 2: (0, True), 3: (0, True), 4: (2, True), 5: (0, False)}
    assert time.monotonic() - begun < 60  # the text is computed once and not for each of its runs
