"""Fingerprints, bit-sliced comparison and components against brute force."""

import random
import re

import numpy as np
import xxhash

from riskloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in ([words[i:i + 3] for i in range(len(words) - 2)] or [words])]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def sets(ids, prints, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_kernel():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 30, size=rng.integers(1, 20))
        values = np.where(rng.random(sizes.sum()) < 0.5, rng.integers(0, 2**63, dtype=np.uint64), rng.integers(0, 2**63, size=sizes.sum(), dtype=np.uint64))
        for _ in range(4):
            values = values ^ np.where(rng.random(len(values)) < 0.7, np.uint64(1) << rng.integers(0, 64, size=len(values)).astype(np.uint64), np.uint64(0))
        ends = np.cumsum(sizes)
        for radius in (0, 1, 3, 5):
            got = {(int(a), int(b)) for x, y in simhash.close(values, sizes, radius) for a, b in zip(x, y, strict=True)}
            assert got == {(i, j) for lo, hi in zip(ends - sizes, ends, strict=True) for i in range(lo, hi) for j in range(i + 1, hi) if int(values[i] ^ values[j]).bit_count() <= radius}


def test_masks_cover_the_radius():
    rnd = random.Random(0)
    for n in (10, 10**6, 10**9, 10**12):
        own = simhash.masks(n, 3)
        for _ in range(200):
            flips = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(flips & m == 0 for m in own)


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "one TWO", "One two  three", "É One two three four\x0bfive", "a " * 30_000, "x\x1fy z w"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], SCHEMA)
    for r in simhash.near_duplicates(df).collect():
        assert r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"


def test_components_with_split_groups(spark):
    rng = np.random.default_rng(1)
    centre = [int(x) for x in rng.integers(0, 2**63, 3)]
    prints = {}
    for i in range(260):
        v = centre[i % 3] if i % 4 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, int(rng.integers(0, 6))):
            v ^= 1 << int(b)
        prints[i] = v
    signed = sorted({v - 2**64 if v >> 63 else v for v in prints.values()})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = sets([v for v in signed], {v: v & (2**64 - 1) for v in signed})
    for group in (7, 1024):
        got = {r.node: r.root for r in simhash.components(simhash.links(nodes, 3, group)).collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_documents(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(12)]
    rows = [(i, texts[i % 12] + (" extra" if i > 40 else "")) for i in range(60)] + [(60, None), (61, ""), (62, "  "), (None, "  "), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df, group=3).collect()]
    want = sets([i for i, _ in rows[:63]], {i: plain_fingerprint(t) for i, t in rows[:63]})
    assert sorted(map(str, got)) == sorted(map(str, [*want.items(), (None, 60), (3, want[3])]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
