"""The threshold algorithm against all inner products."""

import math
import random

import numpy as np
import pytest

from riskloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, every=50, k=5):
    good = {i: [math.floor(256 * x) for x in v] for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in good.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_against_all_products(spark, spread):
    rnd = random.Random(4)
    f32 = lambda x: float(np.float32(x))
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [f32(c + rnd.gauss(0, spread)) for c in rnd.choice(centres)], "x", "y") for i in range(400)]
    rows += [(1000, [f32(0.5)] * 8, "x", "y"), (1001, [f32(0.5)] * 8, "x", "y"), (1050, [0.0] * 8, "x", "y"),
             (1100, None, "x", "y"), (1150, [None] * 8, "x", "y"), (1200, [float("nan")] * 8, "x", "y"), (1250, [float("inf")] * 8, "x", "y"), (None, [1.0] * 8, "x", "y")]
    df = spark.createDataFrame([*rows, rows[3]], SCHEMA)  # a repeated row counts once
    vectors = topk.quantised(df)
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), rows=97, query_rows=3)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_large_components_and_negatives(spark):
    big = [(0, 21), (1, 21), (2, 22), (3, 23)]
    rows = [(i, [float(1 << e)] * 4, "", "") for i, e in big]
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = topk.quantised(df)
    assert [tuple(r)[1:] for r in topk.top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 3, 1 << 62), (2, 2, 1 << 61), (3, 1, 1 << 60)]
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([-1, 1]) * float(np.float32(2.0 ** rnd.uniform(18, 20.9))) for _ in range(5)], "", "") for i in range(300)]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), rows=100)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_python_integers_and_scores_that_fit_no_long():
    values = np.array([[2.0**70, 1.0], [2.0**70, -3.0], [-(2.0**71), 5.0]])
    lists = topk.Lists(np.array([1, 2, 3]), values)
    which, ids, scores = lists.search(np.array([9, 2]), np.array([[0.0, 7.0], [1.0, 2.0]]), 2)
    assert which.tolist() == [0, 0, 1, 1] and ids.tolist() == [3, 1, 1, 3] and scores.tolist() == [35, 7, (1 << 70) + 2, 10 - (1 << 71)]
    assert topk.fits(scores[:2]).tolist() == [35, 7]
    with pytest.raises(OverflowError):
        topk.fits(scores)


def test_stops_early():
    rng = np.random.default_rng(0)
    values = np.zeros((4000, 2))
    values[:, 0] = np.arange(4000)
    values[:, 1] = rng.integers(0, 3, 4000)
    lists = topk.Lists(np.arange(4000), values)
    _, ids, _ = lists.search(np.array([-1]), np.array([[5.0, 1.0]]), 3)
    assert lists.looked_up < 1000 and set(ids) <= set(range(3990, 4000))


def test_clustered_vectors_are_mostly_not_looked_up():
    rng = np.random.default_rng(1)
    centres = np.eye(16) * 200
    values = np.floor(centres[rng.integers(0, 16, 6000)] + rng.normal(0, 4, (6000, 16)))
    values = np.where(np.abs(values) < 20, 0, values)
    lists, q = topk.Lists(np.arange(6000), values), values[::50]
    found = set()
    for some in topk.batches(q):
        which, ids, scores = lists.search(np.arange(0, 6000, 50)[some], q[some], 5)
        found |= set(zip((some[which] * 50).tolist(), ids.tolist(), scores.astype(int).tolist(), strict=True))
    assert lists.looked_up < len(q) * 6000 / 2
    whole = (q @ values.T).astype(int)
    for i in range(len(q)):
        best = sorted((-whole[i, j], j) for j in range(6000) if j != 50 * i)[:5]
        assert {(50 * i, j, -s) for s, j in best} <= found
    assert len(found) == 5 * len(q)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (1, [2.0, 1.0], "", "")], SCHEMA)
    assert [tuple(r) for r in topk.search_table(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search_table(df.limit(0)).count() == 0
    assert topk.search_table(df.where("vec_id = 0")).count() == 0
