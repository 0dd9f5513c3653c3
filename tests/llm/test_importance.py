"""Importance resampling against plain sums, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, _able string, source string"


def found(text, longest, buckets):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(found(text, longest, buckets)[1])
    for text in target:
        t.update(found(text, longest, buckets)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t_all := s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    assert t_all
    rows = []
    for i, text in docs:
        words, own = found(text, longest, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return sorted(repr((*r, None)) for r in rows if r[1] < least) + [repr((*r, k + 1 if k < drawn else None)) for k, r in enumerate(able)]


def sample(rnd, n=400):
    words = [f"{rnd.choice('abcdé')}{k}" for k in range(300)] + ["Ünï", "UPPER", "日本", "x_y", "{z}"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 25, 60, 200])))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "!!! ---"), (1003, "w " * 30_000), (None, "null id " * 20), (None, "null id " * 20), (5, "same id " * 15), (5, "same id " * 15)]
    return docs, [" ".join(rnd.choice(words[:60]) for _ in range(80)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_matches_plain_sums(spark, longest, buckets):
    docs, target = sample(random.Random(longest))
    df = spark.createDataFrame([(i, t, "own", "own", "kept") for i, t in docs], SCHEMA).repartition(5)
    of = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, of, longest=longest, buckets=buckets, keep=("source", "rank"))
    assert got.columns == ["doc_id", "source", "n_words", "n_features", "weight", "score", "rank"]
    rows = [(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(brute(docs, target, longest, buckets))


def test_bit_planes_give_the_exact_sum():
    rng = np.random.default_rng(0)
    gain = rng.integers(-30_000, 30_000, 1001)
    text = np.repeat(np.arange(700), rng.integers(0, 300, 700))
    bucket = np.minimum(rng.zipf(1.3, len(text)) - 1, 1000)
    want = np.zeros(700, np.int64)
    np.add.at(want, text, gain[bucket])
    assert (importance.GainPlanes(gain).sums(text, bucket, 700) == want).all()
    assert (importance.GainPlanes(np.zeros(8, np.int64)).sums(text[:9], bucket[:9] % 8, 700) == 0).all()


def test_words_do_not_cross_texts():
    texts = pa.array(["ab", "cd", None, "", "e f", "g"])
    text, _, words = importance.features(texts, 2, 1 << 20)
    assert words.tolist() == [1, 1, 0, 0, 2, 1]
    assert sorted(text.tolist()) == [0, 1, 4, 4, 4, 5]
    sliced = importance.features(texts.slice(4), 1, 1 << 20)
    assert sliced[2].tolist() == [2, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(i, "w " * 30, None, None, None) for i in range(20)], SCHEMA)
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs, none)
    assert got.count() == 20 and got.where(F.col("rank").isNotNull()).count() == 2
