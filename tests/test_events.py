"""Per-key event features on inline tables (FIXTURES §3 B, C, D) and invariants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import events as EV

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _by_key(df, cols):
    return {r["application_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_group_sizes_and_constants(spark):
    data = [("n1", 1.0), ("n2", 1.0), ("n2", 2.0), ("n3", 1.0), ("n3", 2.0), ("n3", 4.0),
            ("c4", 5.0), ("c4", 5.0), ("c4", 5.0), ("c4", 5.0), ("nul", None), ("nul", None), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    out = _by_key(EV.event_features(df, key="k"), ["amplitude_v_std", "amplitude_v_skew", "amplitude_v_kurt"])
    assert set(out) == {"n1", "n2", "n3", "c4", "nul"}  # NULL key gives no row
    assert out["n1"] == (None, None, None)
    assert out["n2"][1] is None and out["n2"][2] is None
    assert out["n3"][1] is not None and out["n3"][2] is None
    assert out["c4"] == (0.0, 0.0, 0.0)
    assert out["nul"] == (None, None, None)


def test_quantiles_match_linear_interpolation(spark):
    import numpy as np
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, -5.0, 0.0, 0.0, 1e-300, -2.5e10]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 7.0)], "k string, v double")
    out = _by_key(EV.event_numeric_stats(df, key="k"), ["amplitude_v_q25", "amplitude_v_median", "amplitude_v_q75"])
    want = tuple(float(np.quantile(vals, q)) for q in (0.25, 0.5, 0.75))
    assert out["a"] == pytest.approx(want)
    assert out["b"] == (7.0, 7.0, 7.0)


def test_intervals(spark):
    data = [("a", T0), ("a", T0 + dt.timedelta(seconds=10)), ("a", T0 + dt.timedelta(seconds=40)),
            ("b", T0), ("c", T0), ("c", T0)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz")
    cols = ["amplitude_t_span_seconds", "amplitude_t_avg_interval", "amplitude_t_std_interval"]
    out = _by_key(EV.event_intervals(df, key="k"), cols)
    assert out["a"][0] == 40.0 and out["a"][1] == 20.0 and out["a"][2] == pytest.approx(14.142136, abs=1e-6)
    assert out["b"] == (None, None, None)
    assert out["c"] == (0.0, 0.0, None)


def test_intervals_split_across_time_buckets(spark):
    # gaps that cross bucket edges must equal the gaps of the whole ordered sequence
    times = [T0 + dt.timedelta(seconds=s) for s in (0, 5, 3600 * 30, 3600 * 30 + 1, 3600 * 100)]
    df = spark.createDataFrame([("a", t) for t in times], "k string, t timestamp_ntz")
    small = _by_key(EV.event_intervals(df, key="k", bucket_us=3600 * 10**6), ["amplitude_t_avg_interval", "amplitude_t_std_interval"])
    big = _by_key(EV.event_intervals(df, key="k", bucket_us=10**15), ["amplitude_t_avg_interval", "amplitude_t_std_interval"])
    assert small["a"] == pytest.approx(big["a"])


def test_hour_rules(spark):
    day = dt.datetime(2024, 1, 3)  # Wednesday
    hm = [(6, 59), (7, 0), (21, 59), (22, 0), (8, 59), (9, 0), (17, 59), (18, 0)]
    df = spark.createDataFrame([(f"k{i}", day.replace(hour=h, minute=m)) for i, (h, m) in enumerate(hm)],
                               "k string, t timestamp_ntz")
    out = _by_key(EV.temporal_features(df, key="k"), ["temporal_t_night_ratio", "temporal_t_business_hours_ratio"])
    night = [out[f"k{i}"][0] for i in range(len(hm))]
    business = [out[f"k{i}"][1] for i in range(len(hm))]
    assert night == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert business == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0]


def test_sessions_and_weekend(spark):
    sat = dt.datetime(2024, 1, 6, 12, 0)  # Saturday
    data = [("a", sat), ("a", sat + dt.timedelta(minutes=10)), ("a", sat + dt.timedelta(minutes=50)),
            ("a", sat + dt.timedelta(days=3))]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz")
    out = _by_key(EV.session_features(df, key="k"),
                  ["amplitude_session_count", "amplitude_avg_session_duration", "amplitude_weekend_ratio"])
    # sessions: [0, 10 min], [50 min], [+3 days] -> lengths 600, 0, 0
    assert out["a"][0] == 3 and out["a"][1] == pytest.approx(200.0) and out["a"][2] == 0.75


def test_change_counts(spark):
    data = [("a", T0, "x"), ("a", T0 + dt.timedelta(seconds=1), "x"), ("a", T0 + dt.timedelta(seconds=2), "y"),
            ("a", T0 + dt.timedelta(seconds=3), None), ("a", T0 + dt.timedelta(seconds=4), None), ("b", T0, "z")]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, s string")
    out = _by_key(EV.change_counts(df, ["s"], key="k"), ["amplitude_s_changes"])
    assert out == {"a": (2,), "b": (0,)}


def test_partition_count_does_not_change_result(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = EV.event_features(ev.repartition(1), key="user_id")
    b = EV.event_features(ev.repartition(7), key="user_id")
    sort = sorted(a.columns)
    ra = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.select(*sort).collect())
    rb = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.select(*sort).collect())
    assert ra == rb


def test_exact_quantiles_hot_group_against_numpy(spark):
    import numpy as np

    from riskloom.operators import quantiles as QT
    rng = np.random.default_rng(3)
    hot = np.concatenate([rng.normal(0, 1e3, 20000), rng.integers(-5, 5, 5000).astype(float), [0.0] * 100])
    data = [("hot", float(v)) for v in hot] + [("cold", 1.5), ("cold", -2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = {r["k"]: r for r in QT.exact_quantiles(df, ["k"], ["v"], qs).collect()}
    for q in qs:
        assert out["hot"][f"v_q{q}"] == pytest.approx(float(np.quantile(hot, q)), rel=1e-12, abs=1e-9)
        assert out["cold"][f"v_q{q}"] == pytest.approx(float(np.quantile([1.5, -2.0], q)))
    plan = QT.exact_quantiles(df, ["k"], ["v"], qs)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


def test_order_bucket_is_monotone(spark):
    from riskloom.operators import quantiles as QT
    vals = sorted([float("-inf"), -1e308, -3.5, -1.0, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 0.999999, 1.0, 1.0000001,
                   2.0, 7.9999999, 8.0, 1e308, float("inf")])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    b = [r[0] for r in df.orderBy("i").select(QT.order_bucket(F.col("v"))).collect()]
    assert b == sorted(b)


def test_hot_bucket_split_is_exact(spark):
    from riskloom.operators import ordered as O
    rng = __import__("random").Random(5)
    base = 1_704_067_200_000_000
    rows = [("hot", base + rng.randrange(0, 3600 * 10**6), rng.choice("xyz")) for _ in range(3000)]
    rows += [("hot", base + 5, "x"), ("hot", base + 5, "y")]  # equal times stay in one slice
    rows += [("cold", base + i * 7 * 10**8, "x") for i in range(50)]
    df = spark.createDataFrame([(k, u, v, i) for i, (k, u, v) in enumerate(rows)], "k string, us long, v string, i int")

    def run(hot_rows):
        g = {r["k"]: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
             for r in O.gap_moments(df, "k", "us", ["i"], hot_rows=hot_rows).collect()}
        c = {r["k"]: r["v"] for r in O.change_counts(df, "k", "us", ["v"], ["i"], hot_rows=hot_rows).collect()}
        s = sorted(tuple(r) for r in O.session_pieces(df, "k", "us", 60 * 10**6, ["i"], hot_rows=hot_rows)
                   .select("k", "start_us", "end_us", "n").collect())
        return g, c, s

    assert run(7) == run(10**9)
