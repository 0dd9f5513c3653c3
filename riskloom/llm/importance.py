"""Target-distribution importance resampling by bit-sliced aggregation.

Features are runs of words, hashed into buckets.  The buckets' shares among all documents and among the
target texts give every bucket an integer gain.  A document's bucket counts become bit planes, one bit per bucket and
power of two; the gains' magnitudes become planes too, positive and negative ones apart.  The popcounts of all ANDs
of two planes, times the powers of two they stand for, add up to the exact sum of gains over the document's features.
Weight is its floored mean; a draw without replacement takes the highest scores, weight plus a Gumbel
variable that a digest of the id gives (Gumbel top-k).

Nulls and texts without a word have no feature, weight 0, and are never drawn.  A null id is hashed as no
digits and comes last among equal scores; repeated rows have equal scores and get neighbouring ranks.  A very long text
only makes more planes; a task holds one slice of about 4 MB, or one text.  Empty tables give empty results;
an empty target has equal shares.  Of the input only ``doc_id``, ``text`` and the columns named in ``keep`` are read;
of these, those named like an added column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import runs
from riskloom.llm.common import written
from riskloom.llm.grams import slices

BUCKETS, BLOCK = 10_000, 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
MEASURES = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every feature of a slice, and the number of words of every text."""
    raw, at = runs.content(texts)
    data = LOWER[raw]
    inside = IS_WORD[data]
    starts, ends = runs.places(inside, at)
    bounds = np.searchsorted(starts, at)
    word, known = runs.codes(data[inside], ends - starts)
    spelt = known.to_pylist()
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found = [(text, np.array([zlib.crc32(w) % buckets for w in spelt], np.int64)[word] if spelt else word)]
    for n in range(2, longest + 1):
        m = max(0, len(word) - n + 1)
        own = text[:m] == text[len(word) - m:]  # the run's last word stands in the same text
        first = np.flatnonzero(own)
        _, example, which = np.unique(runs.joint(*[word[first + k] for k in range(n)]), return_index=True, return_inverse=True)
        hashes = [zlib.crc32(b" ".join([spelt[word[first[e] + k]] for k in range(n)])) % buckets for e in example]
        found.append((text[first], np.array(hashes, np.int64)[which] if hashes else first))
    return np.concatenate([t for t, _ in found]), np.concatenate([b for _, b in found]), np.diff(bounds)


def corpus_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features of all texts per bucket: one row per task and bucket that occurs is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo, hi in slices(b.column(0)):
                total += np.bincount(features(b.column(0).slice(lo, hi - lo), longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares in target and source, floored."""
    s, t, k = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    bits = np.packbits(flags, axis=-1, bitorder="little")
    full = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 8) * 8), np.uint8)
    full[..., :bits.shape[-1]] = bits
    return full.view(np.uint64)


class GainPlanes:
    """Signed gains as (power of two with sign, plane)."""

    def __init__(self, gain: np.ndarray):
        self.buckets, self.planes = len(gain), []
        for sign in (1, -1):
            size = np.maximum(sign * gain, 0)
            for j in range(int(size.max(initial=0)).bit_length()):
                self.planes.append((sign << j if sign > 0 else -(1 << j), packed(size >> j & 1 != 0)))

    def sums(self, text: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        """Sum of the gains of each text's features."""
        out = np.zeros(texts, np.int64)
        for lo in range(0, texts, BLOCK):
            hi = min(lo + BLOCK, texts)
            own = (text >= lo) & (text < hi)
            cell, count = np.unique((text[own] - lo) * self.buckets + bucket[own], return_counts=True)
            for i in range(int(count.max(initial=0)).bit_length()):
                ones = cell[count >> i & 1 != 0]
                having, row = np.unique(ones // self.buckets, return_inverse=True)  # texts with a count of that bit
                flags = np.zeros((len(having), self.buckets), bool)
                flags[row, ones % self.buckets] = True
                plane = packed(flags)
                for power, gain in self.planes:
                    out[lo + having] += (power << i) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
        return out


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, and n_words, n_features, weight of every document."""
    taken = {f.name for f in MEASURES} | {"score", "rank", "text"}
    fields = [f for f in docs.select("doc_id", *keep).schema.fields if f.name.lower() not in taken]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = GainPlanes(shared.value)
        for whole in batches:
            for lo, hi in slices(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                text, bucket, words = features(b.column("text"), longest, planes.buckets)
                order = np.argsort(text, kind="stable") if longest > 1 else slice(None)
                n = np.bincount(text, minlength=len(words))
                weight = planes.sums(text[order], bucket[order], len(words)) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + [pa.array(x, pa.int64()) for x in (words, n, weight)],
                                                 names=[f.name for f in [*fields, *MEASURES]])

    rows = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col("text"))
    return rows.mapInArrow(run, T.StructType([*fields, *MEASURES]))


def scored(weighed: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: weight plus 1000 times a Gumbel variable."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighed.withColumn("score", F.col("weight") + gumbel)


def ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds ``rank`` to the drawn rows: the highest scores among rows of enough words.

    The rows are range-sorted and written once with their place inside their range, so that a repeated task reads the
    same places; the ranges' sizes (one row each) give what stands before a range.  A last sort key spreads
    rows that are equal in score and id.
    """
    able, spread = F.col("n_words") >= least_words, F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    order = [F.col("_able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_spread").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn("_able", able).withColumn("_spread", spread).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = written(ranges.drop("_spread").withColumn("_range", F.spark_partition_id()).withColumn("_place", place), "ranges")
    sizes = at.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.count_if("_able").alias("able")).orderBy("_range").collect()
    drawn, before, offsets = percent * sum(r["able"] for r in sizes) // 100, 0, []
    for r in sizes:
        offsets.append((r["_range"], before))
        before += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, "_range int, _before long")  # one row per range
    rank = F.col("_before") + F.col("_place") + 1
    return at.join(F.broadcast(table), "_range").select(*rows.columns, F.when(F.col("_able") & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20,
             percent: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, and n_words, n_features, weight, score, rank of every document; those with a rank are drawn.

    ``percent`` of the documents of at least ``least_words`` words are drawn towards the distribution of ``target.text``.
    """
    gain = gains(corpus_counts(docs, longest, buckets), corpus_counts(target, longest, buckets))
    rows = written(scored(weights(docs, gain, longest, keep), seed), "weights")  # the range sort reads its input twice
    return ranked(rows, least_words, percent)


SQL = r"""
WITH RECURSIVE step AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UBIGINT) AS b FROM (SELECT DISTINCT w FROM words)),
hashed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket FROM bytes, crcs),
coded AS (SELECT side, id, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
held AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM coded GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM held),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM held, totals),
mass AS (SELECT id AS doc_id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g FROM coded JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS gumbel
    FROM documents LEFT JOIN mass USING (doc_id)),
ranks AS (SELECT *, weight + gumbel AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + gumbel DESC, doc_id) AS r,
    count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM ranks
"""
