"""Edge cases: hot keys, missing and non-finite values, odd CSV files, repeated keys."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.operators import apps as A
from riskloom.operators import assemble as M
from riskloom.operators import calls as C
from riskloom.operators import events as EV
from riskloom.operators import metrics as MT
from riskloom.operators import quality as Q
from riskloom.operators import ranks
from riskloom.operators import signals as SG
from riskloom.operators import splits as SP
from riskloom.sources import files as FS
from riskloom.sources import sinks
from riskloom.sources.tables import read_event_chunks, unread_chunks

KEY = S.CANONICAL_KEY


# ---- link CSV ---------------------------------------------------------------------------

def _folder(**files: bytes) -> str:
    d = tempfile.mkdtemp(prefix="riskloom-csv-")
    for name, data in files.items():
        with open(os.path.join(d, f"{name}.csv"), "wb") as f:
            f.write(data)
    return d


def test_link_csv_many_columns_and_blank_header(spark):
    names = [f"c{i}" for i in range(70)]
    wide = (",".join(names) + "\n" + ",".join(f"v{i}" for i in range(70)) + "\n").encode()
    d = _folder(wide=wide, blank=b"file,,APPLICATIONID\nx.wav,zz,77\n")
    rows = {os.path.basename(r["source_file"]): r.asDict() for r in FS.read_link_csv(spark, d).collect()}
    assert [rows["wide.csv"][c] for c in names] == [f"v{i}" for i in range(70)]
    assert (rows["blank.csv"]["file"], rows["blank.csv"]["APPLICATIONID"]) == ("x.wav", "77")


def test_link_csv_quoted_break_charsets_and_rejects(spark):
    d = _folder(a='Файлы,note\nx.wav,"one\ntwo ""q"""\ny.wav,short\nz.wav,a,b,c\n'.encode(), b="Файлы,note\nж.wav,Ёлка\n".encode("cp1251"), empty=b"")
    got = FS.read_link_csv(spark, d)
    rows = {r["Файлы"]: r for r in got.collect()}
    assert rows["x.wav"]["note"] == 'one\ntwo "q"' and rows["y.wav"]["note"] == "short"
    assert rows["ж.wav"]["note"] == "Ёлка" and rows["ж.wav"][FS.REJECT] is None
    assert rows["z.wav"][FS.REJECT] is not None  # a row that does not fit its header is told
    order = [r["Файлы"] for r in got.where(F.col("source_file").endswith("a.csv")).orderBy("link_row").collect()]
    assert order == ["x.wav", "y.wav", "z.wav"]


def _spanning_file(rnd, n):
    import csv
    import io
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"]))
    w.writerow(["Файлы", "APPLICATIONID", "note"])
    cells = ["a", "b c", "", "x,y", 'say ""hi""', "two\nlines", "\n\n", 'q"', "tail\n", ",\n,", "д", '"\n"']
    for i in range(n):
        w.writerow([f"{i}.wav", rnd.choice(cells), "".join(rnd.choice(cells) for _ in range(rnd.randrange(4)))])
    text = out.getvalue()
    at = text.index("\n", len(text) // 2)
    return text[:at + 1] + '5.wav,5" disk,an 3.5" one\n' * (text[at - 1] != "\r" and text[:at + 1].count('"') % 2 == 0) + text[at + 1:]


def test_quoted_breaks_are_read_by_several_tasks(spark):
    rnd = random.Random(3)
    d = tempfile.mkdtemp(prefix="riskloom-link-")
    for k in range(3):
        with open(f"{d}/{k}.csv", "w", encoding="utf-8", newline="") as f:
            f.write(_spanning_file(rnd, 700))
    with open(f"{d}/3.csv", "w", encoding="cp1251", newline="") as f:
        f.write('Файлы,APPLICATIONID,note\nя.wav,"две\nстроки",x\n"no\nend",y,')
    one = {"3.csv": [("я.wav", "две\nстроки", "x"), ("no\nend", "y", None)]}
    for k in range(3):
        one[f"{k}.csv"] = [tuple(r) for r in spark.read.csv(f"{d}/{k}.csv", header=True, multiLine=True, escape='"').collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        got = FS.read_link_csv(spark, d)
        kept = got.orderBy("link_row").collect()
        blocks = {(r["source_file"], r["link_row"]["block"]) for r in kept}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(blocks) > 30
    for name, rows in one.items():
        assert [(r["Файлы"], r["APPLICATIONID"], r["note"]) for r in kept if r["source_file"].endswith(name)] == rows


def test_chunks_union_and_unread(spark):
    d = tempfile.mkdtemp(prefix="riskloom-chunks-")
    spark.createDataFrame([(1, "a")], "id int, props string").write.parquet(f"{d}/chunk_0")
    spark.createDataFrame([(2,)], "id int").write.parquet(f"{d}/chunk_1")
    os.makedirs(f"{d}/chunk_2")
    with open(f"{d}/chunk_2/bad.parquet", "wb") as f:
        f.write(b"PAR1 not a parquet file PAR1")
    assert sorted((r.id, r.props) for r in read_event_chunks(spark, f"{d}/chunk_[01]").collect()) == [(1, "a"), (2, None)]
    missed = [os.path.basename(r.path) for r in unread_chunks(spark, [f"{d}/chunk_0", f"{d}/chunk_1", f"{d}/chunk_2"]).collect()]
    assert "bad.parquet" in missed


def _damaged_chunk(spark, d):
    """A file of several row groups, one of which has its pages overwritten."""
    import pyarrow.parquet as pq
    spark.range(40_000).selectExpr("id", "cast(id * 7919 % 10007 as string) AS props").coalesce(1).write.parquet(f"{d}/plain")
    rows = pq.read_table(f"{d}/plain")
    os.makedirs(f"{d}/chunk_3")
    path = f"{d}/chunk_3/part.parquet"
    pq.write_table(rows, path, row_group_size=8_000)
    group = pq.ParquetFile(path).metadata.row_group(3).column(1)
    start = min(x for x in (group.dictionary_page_offset, group.data_page_offset) if x is not None)
    with open(path, "r+b") as f:
        f.seek(start)
        f.write(b"\xff" * group.total_compressed_size)


def test_partly_damaged_chunk_is_rejected_whole(spark):
    d = tempfile.mkdtemp(prefix="riskloom-chunks-")
    _damaged_chunk(spark, d)
    spark.createDataFrame([(1, "a")], "id long, props string").write.parquet(f"{d}/chunk_0")
    spark.createDataFrame([], "id long, props string").coalesce(1).write.parquet(f"{d}/chunk_1")
    part = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{d}/chunk_3").selectExpr("count(props)", "sum(id)").first()[0]
    assert 0 < part < 40_000  # what a tolerant reader would keep of it
    assert [tuple(r) for r in read_event_chunks(spark, f"{d}/chunk_*").select("id", "props").collect()] == [(1, "a")]
    rejects = unread_chunks(spark, f"{d}/chunk_*").collect()
    assert [(os.path.basename(r["path"]), r["expected"]) for r in rejects] == [("part.parquet", 40_000)] and 0 < rejects[0]["read"] < 40_000


def test_no_readable_chunk(spark):
    d = tempfile.mkdtemp(prefix="riskloom-chunks-")
    os.makedirs(f"{d}/chunk_0")
    with open(f"{d}/chunk_0/bad.parquet", "wb") as f:
        f.write(b"PAR1 not a parquet file PAR1")
    assert [(r["expected"], r["read"]) for r in unread_chunks(spark, f"{d}/chunk_*").collect()] == [(None, 0)]
    got = read_event_chunks(spark, f"{d}/chunk_*")
    assert got.count() == 0 and got.columns == ["source_chunk"]


def test_call_files_and_summary_of_a_folder(spark):
    d = tempfile.mkdtemp(prefix="riskloom-data-")
    os.makedirs(f"{d}/audiofiles/old")
    for name in ("a.wav", "b.mp3", "c.flac", "d.txt", "old/e.wav"):
        with open(f"{d}/audiofiles/{name}", "wb") as f:
            f.write(b"12345")
    got = FS.list_call_files(spark, f"{d}/audiofiles").collect()
    assert sorted((r["file_name"], r["file_size"]) for r in got) == [("a.wav", 5), ("b.mp3", 5), ("c.flac", 5)]
    spark.range(10).write.parquet(f"{d}/train_amplitude_chunk_1.parquet")
    spark.range(5).write.parquet(f"{d}/train_amplitude_chunk_2.parquet")
    summary = {r["kind"]: r for r in FS.source_summary(spark, d).collect()}
    assert (summary["amplitude_chunks"]["n_sources"], summary["amplitude_chunks"]["n_rows"]) == (2, 15)
    assert summary["labels"]["present"] == 0 and summary["audio"]["n_files"] == 4 and summary["audio"]["n_rows"] is None
    status = {r["kind"]: r["status"] for r in FS.source_presence(FS.source_summary(spark, d)).collect()}
    assert status["labels"] == "error" and status["link_table"] == "warning" and status["audio"] == "ok"


# ---- hot keys ---------------------------------------------------------------------------

HOT_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "64"}


@pytest.fixture
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in HOT_CONF}
    for k, v in HOT_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_splits_a_hot_key(spark, hot):
    n = 60_000
    events = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias(KEY),
                                   F.md5(F.col("id").cast("string").cast("binary")).alias("v"))
    sides = [events.select(KEY).distinct().withColumn(c, F.length(KEY)) for c in ("a", "b")]
    merged = M.merge_all_left(events, *sides)
    assert "skew=true" in _final_plan(merged) and merged.count() == n
    labels = events.select(KEY).distinct().withColumn("target", F.lit(1))
    both = M.merge_all(events, *sides, labels, "target")
    assert "skew=true" in _final_plan(both) and both.count() == n
    assert both.columns == [KEY, "v", "a", "b", "label"]


def test_merge_all_equals_two_steps(spark):
    events = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], f"{KEY} string, x int")
    apps = spark.createDataFrame([("a", 5), ("z", 6)], f"{KEY} string, x int")
    calls = spark.createDataFrame([("b", 7)], f"{KEY} string, y int")
    labels = spark.createDataFrame([("a", 1, 9), ("a", 0, 8), ("b", 0, 7), (None, 1, 1)], f"{KEY} string, target int, y int")
    two = M.merge_with_labels(M.merge_all_left(events, apps, calls), labels, "target")
    one = M.merge_all(events, apps, calls, labels, "target").select(*two.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() == 2  # one label per key
    assert {c for c in two.columns} == {KEY, "x", "x_app", "y", "label"}


def test_phone_join_leaves_settled_calls_out(spark, hot):
    calls = spark.range(30_000).select(
        F.col("id").cast("string").alias("file_name"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, F.lit("777")).otherwise(F.col("id").cast("string")).alias("phone"))
    link = spark.createDataFrame([("0.wav", "A", "555", 1), (None, "B", "777", 2)], "file string, application string, tel string, link_row long")
    got = C.link_calls_fallback(calls, link, "tel")
    assert got.count() == 30_000
    assert {r["link_method"]: r["count"] for r in got.groupBy("link_method").count().collect()} == {"phone": 10_000, None: 20_000}


# ---- values -----------------------------------------------------------------------------

def test_gap_deviation_keeps_digits(spark):
    rng = np.random.default_rng(0)
    t0, rows, us = dt.datetime(2024, 1, 1), [], 0
    for _ in range(3000):
        rows.append(("k", t0 + dt.timedelta(microseconds=us)))
        us += 86_400_000_000 + int(rng.integers(-100, 101))
    df = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz")
    got = EV.event_intervals(df, "user_id").first()
    gaps = np.diff([int((t - t0) / dt.timedelta(microseconds=1)) for _, t in rows]) / 1e6
    assert got["amplitude_ts_std_interval"] == pytest.approx(gaps.std(ddof=1), rel=1e-6)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 3.0), ("k", float("nan"))], "user_id string, v double")
    r = EV.event_numeric_stats(df, "user_id").first()
    assert (r["amplitude_v_mean"], r["amplitude_v_max"], r["amplitude_v_median"]) == (2.0, 3.0, 2.0)


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("12D", " 1.5 ", "nan", 1.0), ("7F", "-2e3", "inf", float("nan")), ("0x1", "+.5", "3", None)], "a string, b string, c string, d double")
    prof = {r["column_name"]: r["is_numeric_like"] for r in Q.column_profile(df).collect()}
    assert prof == {"a": 0, "b": 1, "c": 1, "d": 1}
    assert [tuple(r) for r in Q.coerce_types(df).collect()] == [(0.0, 1.5, 0.0, 1.0), (0.0, -2000.0, 0.0, 0.0), (0.0, 0.5, 3.0, 0.0)]
    assert Q.clean_features(df)[1] == ["b", "c", "d"]


def test_align_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, x double")
    assert [tuple(r) for r in Q.align_features(df, ["x", "new"], ("id",)).collect()] == [(1, None, 0.0), (2, 3.0, 0.0)]


def test_split_by_distinct_keys(spark):
    df = spark.createDataFrame([(k, k % 2, i) for k in range(20) for i in range(10)], "k int, label int, i int")
    got = SP.stratified_split(df, "k", "label", 0.2)
    assert got.count() == 200
    tested = got.where("is_test = 1").select("k", "label").distinct()
    assert {r["label"]: r["count"] for r in tested.groupBy("label").count().collect()} == {0: 2, 1: 2}
    assert got.groupBy("k").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    folds = SP.stratified_fold(df, "k", "label", 5).select("k", "label", "fold").distinct()
    assert {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {(c, f): 2 for c in (0, 1) for f in range(5)}


def test_metrics_without_positives_and_with_nan(spark):
    none = spark.createDataFrame([(0.3, 0), (0.7, 0)], "score double, label int")
    assert MT.average_precision(none).first()[0] == 0.0 and MT.auc(none).first()[0] is None
    nan = spark.createDataFrame([(0.9, 1), (0.1, 0), (float("nan"), 0)], "score double, label int")
    assert MT.auc(nan).first()[0] == 1.0
    assert MT.classification_metrics(nan).first()["n"] == 2


def test_running_sums_use_several_tasks(spark, hot):
    rows = spark.range(50_000).select((F.lit(1e9) + F.col("id") / 1000).alias("v"), F.lit(1).alias("one"))
    got = ranks.running(rows, [F.col("v")], {"rank": "one"})
    assert got.where("rank != round((v - 1e9) * 1000) + 1").count() == 0
    assert got.rdd.getNumPartitions() > 1


def test_codes(spark):
    df = spark.createDataFrame([(i, f"c{i % 7}" if i % 5 else None) for i in range(100)], "id int, c string")
    got = {(r["c"], r["app_c_code"]) for r in A.encode_categories(df, ["c"]).collect()}
    assert got == {(f"c{i}", i + 1) for i in range(7)} | {(None, None)}


def test_signals(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, -1.0, 1.0])], "id int, x array<float>")
    assert {r["id"]: r["n_samples"] for r in SG.signal_validity(df, "id", "x").collect()} == {1: 0, 2: 0, 3: 3}
    zcr = {r["id"]: r["zcr_mean"] for r in SG.signal_zcr_stats(df, "id", "x").collect()}
    assert zcr == {1: 0.0, 2: 0.0, 3: pytest.approx(2 / 3)}


def test_overlap_gate(spark):
    a = spark.createDataFrame([("x",), ("y",)], f"{KEY} string")
    b = spark.createDataFrame([("z",)], f"{KEY} string")
    with pytest.raises(ValueError, match=r"\['x', 'y'\].*\['z'\]"):
        M.require_overlap(a, b)


def test_role_resolvers(spark):
    a = spark.createDataFrame([], "session_id int, user_id int, v int")
    b = spark.createDataFrame([], "user_id int, v int, w int")
    assert S.merge_key(a, b) == "user_id" and S.common_column(a, b) == "user_id"
    assert S.merge_key(a, b.drop("user_id")) is None and S.common_column(a.drop("user_id"), b) == "v"


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="riskloom-sinks-")
    df = spark.createDataFrame([(1, "ж, q", 0.5)], "id int, t string, p double")
    sinks.write_predictions(df, f"{d}/p")
    sinks.write_table_csv(df, f"{d}/t")
    sinks.write_prediction_base(df, f"{d}/b")
    sinks.write_report(spark.createDataFrame([(1, "s", 0, "second"), (0, "s", 1, "first")], "section_no int, section string, ord int, line string"), f"{d}/r")
    assert spark.read.parquet(f"{d}/p/parquet").collect() == df.collect() == spark.read.parquet(f"{d}/b").collect()
    assert spark.read.option("header", True).csv(f"{d}/p/csv").first()["t"] == "ж, q" == spark.read.option("header", True).csv(f"{d}/t").first()["t"]
    assert [r.value for r in spark.read.text(f"{d}/r").collect()] == ["first", "second"]


# ---- order, ranks, keys -----------------------------------------------------------------

def test_hot_hours_are_cut_by_rows(spark):
    from riskloom.operators import ordered as O
    rng = np.random.default_rng(3)
    us = [*(int(x) for x in rng.integers(0, 2_000_000, 2000)), *range(10_000_000, 3_000_000_000, 300_000_000), *[5] * 50]
    df = spark.createDataFrame([("k", u, i % 3) for i, u in enumerate(us)] + [("other", 1, 0)], "key string, us long, c int")
    rows, _ = O.bucketed(df, "key", "us", ["c"], ["c"], hot_rows=100)
    per = [r["count"] for r in rows.where("key = 'k'").groupBy("_bucket").count().collect()]
    assert len(per) >= 20 and max(per) <= 200
    for hot_rows in (100, 10**6):
        m = O.gap_moments(df, "key", "us", ["c"], hot_rows=hot_rows).where("key = 'k'").first()
        gaps = np.diff(sorted(us)) / 1e6
        assert m["gaps"] == len(gaps) and m["gap_mean"] == pytest.approx(gaps.mean()) and m["gap_dev"] == pytest.approx(((gaps - gaps.mean()) ** 2).sum())
        assert O.change_counts(df, "key", "us", ["c"], ["c"], hot_rows=hot_rows).where("key = 'k'").first()["c"] == sum(
            a[1] != b[1] for a, b in zip(*(lambda x: (x, x[1:]))(sorted((u, i % 3) for i, u in enumerate(us)))))


@pytest.mark.parametrize("tied", [True, False])
def test_a_hot_instant_is_cut(spark, tied):
    """One key, one timestamp: with a tiebreak the rows are cut by it; without one, or with equal ones, dealt out."""
    from riskloom.operators import ordered as O
    rows = [("k", 7_000_000, 0 if tied else i, "v" if tied else "xyz"[i % 3]) for i in range(2000)]
    rows += [("k", 7_000_000 + d, 0, "w") for d in (-5_000_000, 5_000_000)] + [("k", 7_200_000_000, 0, "w"), (None, 1, 0, "n"), ("o", 1, 0, "w")]
    df = spark.createDataFrame(rows, "key string, us long, c int, v string").repartition(3)
    got, _ = O.bucketed(df, "key", "us", ["c"], ["c"], hot_rows=100)
    per = got.where("key = 'k'").groupBy("_bucket").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi")).orderBy("_bucket").collect()
    assert max(r["n"] for r in per) <= 200 and len(per) >= 18 and sum(r["n"] for r in per) == 2003
    assert all(a["hi"] <= b["lo"] for a, b in zip(per, per[1:], strict=False))
    for f in (lambda h: O.gap_moments(df, "key", "us", ["c"], hot_rows=h), lambda h: O.change_counts(df, "key", "us", ["v"], ["c"], hot_rows=h),
              lambda h: O.session_pieces(df, "key", "us", 4_000_000, ["c"], hot_rows=h).drop("_sid")):
        assert sorted(map(repr, f(100).collect())) == sorted(map(repr, f(10**6).collect()))


def test_quantiles_of_a_narrow_column(spark):
    from riskloom.operators import quantiles as QT
    v = 1e9 + np.arange(40_001) * 0.001
    df = spark.createDataFrame([(float(x), float(-x)) for x in v], "a double, b double")
    r = QT.exact_quantiles(df, [], ["a", "b"], [0.0, 0.25, 0.5, 0.99, 1.0]).first()
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert r[f"a_q{q}"] == pytest.approx(np.quantile(v, q), rel=1e-15) and r[f"b_q{q}"] == pytest.approx(np.quantile(-v, q), rel=1e-15)


def test_long_keys_finish(spark):
    import random

    from riskloom.operators import keys as K
    rnd = random.Random(0)

    def spoiled(k, n):
        for _ in range(n):
            i = rnd.randrange(len(k))
            k = rnd.choice([k[:i] + k[i + 1:], k[:i] + "x" + k[i:], k[:i] + "y" + k[i + 1:]])
        return k

    base = ["PREFIX-" + "".join(rnd.choice("abcd01") for _ in range(rnd.choice([3, 8, 11, 30, 53]))) for _ in range(60)]
    left, right = base, [spoiled(k, rnd.randrange(0, 6)) for k in base]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {}
    for a in left:
        best = min(((lev(a, b), -max(len(a), len(b)), b) for b in right if 5 * lev(a, b) <= max(len(a), len(b))), default=None)
        if best:
            want[a] = (best[2], best[0])
    got = K.fuzzy_key_map(spark.createDataFrame([(k,) for k in left], "k string"), spark.createDataFrame([(k,) for k in right], "k string"), 0.8)
    assert {r["key"]: (r["match_key"], r["distance"]) for r in got.collect()} == want


# ---- calls: link names, times, sketches --------------------------------------------------

def test_blanks_around_a_linked_path(spark):
    link = spark.createDataFrame([(" \tC:\\rec\\a.wav \n", "A", 1), ("/rec/b.wav ", "B", 2)], "`Файлы` string, APPLICATIONID string, link_row int")
    assert sorted(tuple(r) for r in C.file_map(link).collect()) == [("a.wav", "A"), ("b.wav", "B")]


def test_time_agreement(spark):
    rows = [("k", "2024-01-01 10:00:00", "2024-01-01 10:00:59"), ("k", "2024-01-01 10:00:00", "2024-01-01 09:58:00"), ("k", None, "2024-01-01 10:00:00"), (None, "2024-01-01 10:00:00", None)]
    df = spark.createDataFrame(rows, "application_id string, a string, b string").selectExpr("application_id", "cast(a as timestamp_ntz) call_time", "cast(b as timestamp_ntz) link_time")
    r = C.time_agreement(df).first()
    assert (r["linked_calls"], r["with_times"], r["agreeing"], r["largest_difference"], r["time_agreement"], r["time_grade"]) == (3, 2, 1, 120.0, 0.5, "critical")
    none = C.time_agreement(df.limit(0)).first()
    assert none["time_agreement"] is None and none["time_grade"] is None


def test_sketches_merge_to_the_whole(spark):
    calls = spark.range(30_000).selectExpr("concat('c', id % 9000) call_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 7 as int)) call_time",
                                           "if(id % 3 = 0, array('1'), array()) codes", "id file_size")
    whole = C.call_profile(calls, approx=True).first()
    parts = C.call_sketches(calls)
    assert parts.count() == 14
    merged = C.merged_call_counts(parts).first()
    assert merged["n_call_ids"] == whole["n_call_ids"] and merged["n_files"] == 30_000
    assert abs(merged["n_call_ids"] - 9000) <= 4 * C.SKETCH_ERROR * 9000
    days = C.merged_call_counts(parts, "day").collect()
    exact = {r[0]: r[1] for r in calls.groupBy(F.to_date("call_time")).agg(F.count_distinct("call_id")).collect()}
    assert all(abs(r["n_call_ids"] - exact[r["day"]]) <= 4 * C.SKETCH_ERROR * exact[r["day"]] for r in days)
    assert C.merged_call_counts(C.call_sketches(calls.limit(0)), "kind").count() == 0
