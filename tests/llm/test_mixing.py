"""Weighted fair queueing against a plain simulation."""

import hashlib
import random

from pyspark.sql import functions as F

from riskloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def shared_out(sizes: dict, weights=(5, 2, 1), budget=1.5, repeats=2) -> dict:
    """Targets by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    rest, open_ = budget * sum(sizes.values()), set(order)
    while open_ and rest > 1e-9:
        total, share = sum(weight[s] for s in open_), rest
        rest = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= repeats * sizes[s]:
                rest += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                open_.discard(s)
    return target


def brute(rows, target):
    size = {i: len((t or "").split()) for i, t, _ in rows}
    items = []
    for rn, s in enumerate(target):
        own = sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i, size[i]))
        whole, end = sum(size[i] for i in own), 0
        for i in own:
            end += size[i]
            if size[i]:
                items += [((end + k * whole) / target[s], rn, hashlib.md5(f"0:{i}".encode()).hexdigest(), i, size[i], k) for k in (0, 1)]
    taken, run = dict.fromkeys(size, 0), 0
    for item in sorted(items):
        run += item[4]
        if run > sum(target.values()) + 1e-6:
            break
        taken[item[3]] += item[4]
    return taken


def check(spark, rows):
    df = spark.createDataFrame([(i, t, None, s, 0, "x") for i, t, s in rows], SCHEMA)
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = shared_out(sizes)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"]
    return got, target


def test_mix_matches_simulation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 16)
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 30)), rnd.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "e"), (1002, " \t\n", None), (1003, "x y", "z")]
    got, target = check(spark, rows)
    assert {r["doc_id"]: r["taken"] for r in got} == brute(rows, target)


def test_targets_with_many_sources(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randrange(1, 400), f"s{i % 23}") for i in range(23)]
    check(spark, rows)


def test_empty_repeated_and_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    df = spark.createDataFrame([(None, "a b", None, None, 0, "x"), (None, "a b", None, None, 0, "x"), (1, None, None, "s", 0, "x"), (1, None, None, "s", 0, "x")], SCHEMA)
    got = mixing.mix(df)
    assert got.count() == 4
    assert got.agg(F.sum("taken")).first()[0] <= 6
    long_one = spark.createDataFrame([(1, "w " * 200_000, None, "s", 0, "x"), (2, "w", None, "s", 0, "x")], SCHEMA)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(long_one).collect()}[1] in (0, 200_000, 400_000)
