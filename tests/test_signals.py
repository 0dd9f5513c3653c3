"""Signal features on synthetic tones (FIXTURES §3 L)."""

from __future__ import annotations

import math

import numpy as np
import pytest

from riskloom.operators import signals as SG

RATE = 22050


@pytest.fixture(scope="module")
def tones(spark):
    n = 8192
    sine = [math.sin(2 * math.pi * 440 * i / RATE) for i in range(n)]
    return spark.createDataFrame(
        [(1, [0.0] * n), (2, [1.0 if i % 2 == 0 else -1.0 for i in range(n)]), (3, sine), (4, [])],
        "id int, x array<float>")


def test_rms_and_zcr(spark, tones):
    rms = {r["id"]: r["rms_mean"] for r in SG.signal_rms_stats(tones, "id", "x").collect()}
    zcr = {r["id"]: r["zcr_max"] for r in SG.signal_zcr_stats(tones, "id", "x").collect()}
    assert rms[1] == 0.0 and rms[2] == pytest.approx(1.0) and rms[4] == 0.0
    assert zcr[2] == pytest.approx(1.0, abs=1e-3) and zcr[1] == 0.0


def test_spectral_features_of_tone(spark, tones):
    out = {r["id"]: r for r in SG.signal_features(tones, "id", "x").collect()}
    assert out[3]["spectral_centroid_mean"] == pytest.approx(440, rel=0.15)
    assert out[3]["pitch_mean"] == pytest.approx(440, abs=2)
    assert out[1]["pitch_mean"] == 0.0  # zeros: no pitch
    assert out[4]["audio_processing_error"] == 1 and out[4]["rms_mean"] == 0.0
    assert len(SG.feature_names()) + 3 == 79


def test_validity(spark, tones):
    v = {r["id"]: (r["is_valid"], r["reject_reason"]) for r in SG.signal_validity(tones, "id", "x").collect()}
    assert v[3] == (1, None) and v[4] == (0, "empty")


def test_peak_interpolation_finds_a_tone_between_bins(spark):
    n = 22050
    df = spark.createDataFrame([(f, [math.sin(2 * math.pi * f * i / RATE) for i in range(n)]) for f in (443, 1234, 3777)], "id int, x array<float>")
    for r in SG.signal_features(df, "id", "x", pad="reflect").collect():
        s = SG.Spectra(pad="reflect")
        y = np.sin(2 * np.pi * r["id"] * np.arange(n) / RATE)
        inner = s.pitch(s.magnitudes(y, 0, n, 0)[4:-4])  # frames free of padding
        assert np.abs(inner - r["id"]).max() < 0.5 and r["pitch_mean"] == pytest.approx(r["id"], abs=2)


def test_quiet_and_outside_peaks_are_no_pitch():
    s = SG.Spectra()
    t = np.arange(22050) / RATE
    both = s.pitch(s.magnitudes(np.sin(2 * np.pi * 5000 * t) + 0.05 * np.sin(2 * np.pi * 600 * t), 0, len(t), 0)[4:-4])
    assert len(both) == 0  # 5,000 Hz lies outside, 600 Hz is too quiet beside it
    low = s.pitch(s.magnitudes(np.sin(2 * np.pi * 5000 * t) + 0.5 * np.sin(2 * np.pi * 600 * t), 0, len(t), 0)[4:-4])
    assert np.abs(low - 600).max() < 1


def test_mel_bank_by_hand():
    """Rate 8,000, 8 samples, 2 triangles: 4,000 Hz is 15 + 27 ln 4 / ln 6.4 = 35.163764 mel."""
    assert float(SG.mel_scale(np.array(4000.0))) == pytest.approx(15 + 27 * math.log(4) / math.log(6.4))
    assert SG.mel_scale(np.array([0.0, 200.0, 1000.0])).tolist() == pytest.approx([0, 3, 15])
    top = 15 + 27 * math.log(4) / math.log(6.4)
    a, b = top / 3 * 200 / 3, 1000 * math.exp((2 * top / 3 - 15) * math.log(6.4) / 27)  # 781.417 and 1,893.2 Hz
    want = np.zeros((2, 5))  # bins at 0, 1000, 2000, 3000, 4000 Hz
    want[0, 1] = (b - 1000) / (b - a) * 2 / b
    want[1, 1] = (1000 - a) / (b - a) * 2 / (4000 - a)
    want[1, 2], want[1, 3] = ((4000 - f) / (4000 - b) * 2 / (4000 - a) for f in (2000, 3000))
    assert np.abs(SG.mel_bank(8000, 8, 2) - want).max() < 1e-12
    assert np.abs(SG.dct_matrix(2, 2) - np.array([[1, 1], [1, -1]]) / math.sqrt(2)).max() < 1e-12


def test_cepstra_of_a_tone_by_hand(spark):
    """Eight samples, frames of four every four, padded with zeros: frames 0 0 x0 x1, x2 .. x5, x6 x7 0 0."""
    y = [1.0, 0.0, -1.0, 0.0, 1.0, 0.0, -1.0, 0.0]
    row = SG.signal_features(spark.createDataFrame([(1, y)], "id int, x array<double>"), "id", "x", rate=8000, n_fft=4, hop=4, n_mfcc=2, n_mels=2).first()
    window, frames = [0.0, 0.5, 1.0, 0.5], [[0, 0, 1, 0], [-1, 0, 1, 0], [-1, 0, 0, 0]]
    bank = SG.mel_bank(8000, 4, 2)
    db = []
    for f in frames:
        x = [a * b for a, b in zip(f, window, strict=True)]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * k * j / 4), -math.sin(2 * math.pi * k * j / 4)) for j, v in enumerate(x))) ** 2 for k in range(3)]
        db.append([10 * math.log10(max(sum(w * p for w, p in zip(m, power, strict=True)), 1e-10)) for m in bank])
    floor = max(map(max, db)) - 80
    db = [[max(v, floor) for v in d] for d in db]
    for i, sign in ((0, 1), (1, -1)):
        c = [(d[0] + sign * d[1]) / math.sqrt(2) for d in db]
        assert row[f"mfcc_{i}_mean"] == pytest.approx(sum(c) / 3, abs=1e-6)
        assert row[f"mfcc_{i}_std"] == pytest.approx(np.std(c), abs=1e-6)
        assert (row[f"mfcc_{i}_min"], row[f"mfcc_{i}_max"]) == pytest.approx((min(c), max(c)), abs=1e-6)
    assert row["rms_mean"] == pytest.approx((0.5 + math.sqrt(0.5) + 0.5) / 3)
    # edge-padded: 1 1 1 0 / -1 0 1 0 / -1 0 0 0: crossings 0, 1, 1 of four samples; zero counts as positive
    assert row["zcr_mean"] == pytest.approx((0 + 0.25 + 0.25) / 3)


@pytest.mark.parametrize("pad", ["constant", "reflect"])
def test_chunks_give_the_one_piece_result(spark, pad):
    rng = np.random.default_rng(0)
    made = []
    for k, n in enumerate((1, 2, 63, 64, 65, 400, 1023, 1024, 1025, 4096, 5001)):
        y = rng.normal(size=n) * 0.1 + np.sin(np.arange(n) * 0.7)
        if n == 4096:
            y[1000:3000] = 0  # a silent stretch far below the peak
        made.append((k, y.tolist()))
    made += [(50, [0.5] * 900), (51, [float("nan")] + [1.0] * 900), (52, []), (53, None), (None, [0.25, -0.5] * 500), (None, [0.125] * 1000)]
    df = spark.createDataFrame(made, "id int, x array<double>")
    how = dict(rate=8000, n_fft=64, hop=16, n_mels=12, pad=pad)
    key = lambda r: (r["id"] is None, r["id"], r["rms_mean"])
    one = sorted(SG.signal_features(df, "id", "x", **how).collect(), key=key)
    cut = sorted(SG.signal_features(df, "id", "x", chunk_frames=7, **how).collect(), key=key)
    assert len(one) == len(cut) == len(made)
    for a, b in zip(one, cut, strict=True):
        assert a[0] == b[0] and list(a)[1:] == pytest.approx(list(b)[1:], rel=1e-9, abs=1e-9)
    assert {r["id"] for r in cut if r["audio_processing_error"]} == {51, 52, 53}
    for stats in (SG.signal_rms_stats, SG.signal_zcr_stats):
        p = sorted(map(repr, ([round(v, 9) if v is not None else v for v in r] for r in stats(df.where("id <> 51"), "id", "x", 64, 16).collect())))
        q = sorted(map(repr, ([round(v, 9) if v is not None else v for v in r] for r in stats(df.where("id <> 51"), "id", "x", 64, 16, chunk_frames=5).collect())))
        assert p == q


def test_a_long_signal_spreads_over_tasks(spark):
    df = spark.range(1).selectExpr("id", "transform(sequence(0, 1999999), i -> cast(sin(i * 0.1254) as float)) AS x")
    pieces = SG._pieces(df, "id", "x", SG.F.lit(16), lambda c: (c * 125_000, (c + 1) * 125_000))
    spread = pieces.select(SG.F.spark_partition_id().alias("p")).distinct().count()
    assert pieces.count() == 16 and spread > 2
    r = SG.signal_features(df, "id", "x").first()
    assert r["duration"] == pytest.approx(2_000_000 / RATE) and r["pitch_mean"] == pytest.approx(0.1254 * RATE / (2 * math.pi), abs=0.5)
    assert r["rms_mean"] == pytest.approx(math.sqrt(0.5), abs=1e-3)
