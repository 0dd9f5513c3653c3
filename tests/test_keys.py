"""Fuzzy key matching against brute force (all pairs in Python) and join rules (FIXTURES §3 H)."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from riskloom.operators import keys as K


def _lev(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _brute(left, right):
    out = {}
    for a in set(left):
        best = None
        for b in set(right):
            d, m = _lev(a, b), max(len(a), len(b))
            if m and d * 5 <= m:  # similarity 1 - d/m >= 0.8 in integers
                cand = (d, -m, b)
                best = cand if best is None or cand < best else best
        if best is not None:
            out[a] = (best[2], best[0])
    return out


def test_fuzzy_small_rules(spark):
    left = spark.createDataFrame([("abcde",), ("xyz12",), ("qqqqq",), (None,)], "k string")
    right = spark.createDataFrame([("abcdf",), ("abxde",), ("xyz1",), ("zzzzz",)], "r string")
    got = {r["key"]: (r["match_key"], r["distance"]) for r in K.fuzzy_key_map(left, right, 0.8).collect()}
    assert got == {"abcde": ("abcdf", 1), "xyz12": ("xyz1", 1)}


def test_fuzzy_against_brute_force(spark):
    rnd = random.Random(11)
    alpha = "ab01"
    left = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(3, 11))) for _ in range(120)]
    right = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(3, 11))) for _ in range(120)]
    ldf = spark.createDataFrame([(x,) for x in left], "k string")
    rdf = spark.createDataFrame([(x,) for x in right], "r string")
    got = {r["key"]: (r["match_key"], r["distance"]) for r in K.fuzzy_key_map(ldf, rdf, 0.8).collect()}
    assert got == _brute(left, right)


def test_fuzzy_long_keys_with_repeated_pieces(spark):
    rnd = random.Random(7)
    # an edit in an earlier copy of a gram, the untouched grams frequent
    left = ["QWERTYUIOPQWERTYUIOP"]
    right = ["Q1E2T3U4OPQWERTYUIOP"] + ["Q" + "OPQOPQOPQ" + "".join(rnd.choice("ABCDFGHJKL") for _ in range(5)) + "OPQOP" for _ in range(59)]
    for _ in range(80):
        piece = "".join(rnd.choice("abc01") for _ in range(rnd.randint(2, 9)))
        key = (piece * 12)[:rnd.randint(15, 30)]
        left.append(key)
        edited = list(key)
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(len(edited))
            edited[i:i + rnd.randint(0, 1)] = rnd.choice(["", "x", "a", "0"])
        right.append("".join(edited))
    ldf = spark.createDataFrame([(x,) for x in left], "k string")
    rdf = spark.createDataFrame([(x,) for x in right], "r string")
    got = {r["key"]: (r["match_key"], r["distance"]) for r in K.fuzzy_key_map(ldf, rdf, 0.8).collect()}
    assert got == _brute(left, right) and got[left[0]] == (right[0], 4)


def test_fuzzy_join_keeps_rows(spark):
    left = spark.createDataFrame([(1, "abcde"), (2, "abcde"), (3, "none!")], "id int, k string")
    right = spark.createDataFrame([("abcdf", "x")], "r string, payload string")
    rows = sorted((r["id"], r["payload"], r["key_similarity"]) for r in K.fuzzy_key_join(left, right, "k", "r").collect())
    assert rows == [(1, "x", 0.8), (2, "x", 0.8)]


def _brute_blocks(left, right, t):
    out = {}
    for a in set(left):
        rated = [(-SequenceMatcher(None, a, b).ratio(), b) for b in set(right)]
        rated = sorted(x for x in rated if -x[0] >= t)
        if rated:
            out[a] = (rated[0][1], -rated[0][0])
    return out


@pytest.mark.parametrize("t", [0.8, 0.65])
def test_block_ratio_against_all_pairs(spark, t):
    rnd = random.Random(5)
    def some(lo, hi, alpha="ab01"):
        return "".join(rnd.choice(alpha) for _ in range(rnd.randint(lo, hi)))
    left = [some(0, 10) for _ in range(60)] + [some(12, 22, "abc012") for _ in range(40)] + ["Д\\286\\" + f"{k * 7:09d}" for k in range(20)] + ["x" * 220 + some(3, 9)]
    right = [some(0, 10) for _ in range(60)] + [some(12, 22, "abc012") for _ in range(40)] + [f"Д286-{k * 5:09d}" for k in range(20)] + ["x" * 218 + some(3, 9)]
    for key in list(left[60:100]):
        edited = list(key)
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(edited))
            edited[i:i + rnd.randint(0, 2)] = rnd.choice(["", "x", "a", "0"])
        right.append("".join(edited))
    ldf = spark.createDataFrame([(x,) for x in [*left, None]], "k string")
    rdf = spark.createDataFrame([(x,) for x in [*right, None]], "r string")
    got = {r["key"]: (r["match_key"], r["similarity"]) for r in K.block_key_map(ldf, rdf, t).collect()}
    assert got == _brute_blocks(left, right, t) and len(got) > 60


def test_block_pairs_lose_no_pair(spark):
    rnd = random.Random(8)
    keys = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 19))) for _ in range(90)]
    df = spark.createDataFrame([(k,) for k in set(keys)], "key string")
    pairs = {tuple(r) for r in K._block_pairs(df, df, 4, 5).collect()}
    assert {(a, b) for a in keys for b in keys if SequenceMatcher(None, a, b).ratio() >= 0.8} <= pairs
    assert len(pairs) < len(set(keys)) ** 2 / 4


def test_join_by_blocks(spark):
    left = spark.createDataFrame([(1, "abcde"), (2, "abcde"), (3, "none!")], "id int, k string")
    right = spark.createDataFrame([("deabc", "moved"), ("abcdf", "x")], "r string, payload string")
    rows = sorted((r["id"], r["payload"], r["key_similarity"]) for r in K.fuzzy_key_join(left, right, "k", "r", measure="blocks").collect())
    assert rows == [(1, "x", 0.8), (2, "x", 0.8)]
    with pytest.raises(ValueError):
        K.block_key_map(left.select("k"), right.select("r"), 0)


def test_each_shorter_form_once(spark):
    rnd = random.Random(3)
    cores = {"", "a", "aaaa", "abab"} | {"".join(rnd.choice("ab0") for _ in range(rnd.randint(1, 8))) for _ in range(40)}
    df = spark.createDataFrame([(c, c) for c in cores], "key string, core string")
    for n in range(5):
        got = sorted(tuple(r) for r in K._shorter(df, n).collect())
        assert got == sorted((c, v) for c in cores if len(c) >= n for v in {"".join(w) for w in combinations(c, len(c) - n)})


def test_short_keys_never_meet_by_grams(spark, monkeypatch):
    """Keys of 13 to 16 characters with common grams would meet in pairs without number, only to be dropped again."""
    def refuse(*_):
        raise AssertionError("grams of short keys alone")
    monkeypatch.setattr(K, "_grams", refuse)
    left = spark.createDataFrame([(f"Д\\286\\{k:09d}",) for k in range(0, 60, 3)], "k string")
    right = spark.createDataFrame([(f"Д286-{k:09d}",) for k in range(0, 60, 2)], "r string")
    got = {r["key"]: (r["match_key"], r["distance"]) for r in K.fuzzy_key_map(left, right, 0.8).collect()}
    assert got == _brute([r["k"] for r in left.collect()], [r["r"] for r in right.collect()]) and len(got) == 20


def test_only_pairs_with_a_long_key_meet(spark):
    long = "x" * (K.SHORT_KEY + 1)
    left = spark.createDataFrame([("short", 1), (long, 1)], "key string, on int")
    right = spark.createDataFrame([("other", 1), (long, 1)], "match_key string, on int")
    got = {(r["key"], r["match_key"]) for r in K._with_long(left, right, "on").collect()}
    assert got == {("short", long), (long, "other"), (long, long)}


@pytest.mark.parametrize("measure", ["edits", "blocks"])
def test_cut_down_keys_are_never_broadcast(spark, monkeypatch, measure):
    """They are many times the keys, which Spark's estimate does not see."""
    plans = []
    kept = K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    left = spark.createDataFrame([(f"Д\\286\\{k:09d}",) for k in range(0, 60, 3)], "k string")
    right = spark.createDataFrame([(f"Д286-{k:09d}",) for k in range(0, 60, 2)], "r string")
    best = {"edits": K.fuzzy_key_map, "blocks": K.block_key_map}[measure]
    assert best(left, right, 0.8).count() == 20
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
