"""Scalar expressions on inline edge tables (FIXTURES §3 A, E, G, I, J)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.functions import calls as C
from riskloom.functions import keys as K
from riskloom.functions import risk as R
from riskloom.functions import text as X
from riskloom.operators import explain as E

NAMES = [
    ("20241130151507_503121_77070094034,_500209,_500214.wav",
     ("503121", dt.datetime(2024, 11, 30, 15, 15, 7), "77070094034", ["500209", "500214"])),
    ("20241108150819_Sadvakasova_Altynay_77077011421,_500213,_500214.wav",
     ("Sadvakasova", dt.datetime(2024, 11, 8, 15, 8, 19), "Altynay_77077011421", ["500213", "500214"])),
    ("short.wav", ("short", None, None, [])),
    ("a_b.mp3", ("a_b", None, None, [])),
    ("99999999999999_1_2.wav", ("1", None, "2", [])),
    ("20241130151507_5_7.flac", ("5", dt.datetime(2024, 11, 30, 15, 15, 7), "7.flac", [])),
    ("x_y_", ("y", None, "", [])),
    ("20241130151507_5_7,_,__ ,_9_.wav", ("5", dt.datetime(2024, 11, 30, 15, 15, 7), "7", ["9"])),
]


@pytest.mark.parametrize("name,expected", NAMES)
def test_parse_call_name(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n string").select(C.parse_call_name(F.col("n")).alias("p"))
    r = df.select("p.call_id", "p.call_time", "p.phone", "p.codes").first()
    assert (r[0], r[1], r[2], list(r[3])) == expected


def test_basename_both_separators(spark):
    df = spark.createDataFrame([("/rec/a.wav",), ("C:\\rec\\b.wav",), ("c.wav",)], "p string")
    assert [r[0] for r in df.select(C.basename(F.col("p"))).collect()] == ["a.wav", "b.wav", "c.wav"]


def test_normalize_key(spark):
    df = spark.createDataFrame([(" д\\286\\01 ",), ("Д\\\\286\\\\01",), ("",), (None,)], "k string")
    out = [r[0] for r in df.select(K.normalize_key(F.col("k"))).collect()]
    assert out == ["Д\\286\\01", "Д\\286\\01", None, None]


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (0.8,), (1.0,)], "p double")
    got = [tuple(r) for r in df.select(R.band_by_cut(F.col("p")), R.band_by_threshold(F.col("p"))).collect()]
    assert got == [(None, R.LOW), (R.LOW, R.MEDIUM), (R.MEDIUM, R.HIGH), (R.HIGH, R.HIGH), (R.HIGH, R.HIGH)]


def test_confidence(spark):
    feats = "array<struct<name:string,value:double,readable:string>>"
    ten = [(f"f{i}", 0.5, f"f{i}") for i in range(10)]
    df = spark.createDataFrame([(0.9, []), (0.5, ten), (0.9, ten)], f"p double, fs {feats}")
    got = [round(r[0], 6) for r in df.select(E.confidence(F.col("fs"), F.col("p"))).collect()]
    assert got == [0.8, 0.8, 1.0]


def test_text_counts(spark):
    df = spark.createDataFrame([("Да1-ё",)], "s string")
    r = df.select(F.length("s"), X.digit_count(F.col("s")), X.letter_count(F.col("s")), X.has_special(F.col("s"))).first()
    assert tuple(r) == (5, 1, 3, 1)


def test_clean_explanation_limit(spark):
    df = spark.createDataFrame([("a" * 501,), ("b" * 500,), ("  x\n\n y   z ",)], "s string")
    out = [r[0] for r in df.select(X.clean_explanation(F.col("s"))).collect()]
    assert out[0] == "a" * 497 + "..." and len(out[0]) == 500
    assert out[1] == "b" * 500
    assert out[2] == "x y z"


def test_readable_name(spark):
    df = spark.createDataFrame([("amplitude_session_count",), ("x_amplitude_weekend_ratio_y",), ("audio_zcr_mean",)], "s string")
    out = [r[0] for r in df.select(X.readable_name(F.col("s"))).collect()]
    assert out[0] == "Количество сессий"
    assert out[1] == "Активность в выходные (%)"
    assert out[2] == "Аудио Zcr Mean"
