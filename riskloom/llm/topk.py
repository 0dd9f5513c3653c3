"""Exact top-k search by inner product with Fagin's threshold algorithm.

Method: the candidates are dealt out in blocks; a block keeps, for every dimension, its rows sorted
by that component. Queries meet a block in batches of similar direction. A batch reads its lists in parallel, from
the ends that raise its queries' scores, looks up the full scores of the rows met, once for all its queries, and
a query leaves the batch when its bound, the score of a row that would have the last values read in every list, can
no longer beat its k-th result (a bound equal to it could still tie with a smaller id, so it must fall
below). The best of each block are merged.

Components are whole numbers of any size: scores are computed in doubles while no sum can pass 2^53, in 64-bit integers
while none can pass 2^62, and in Python's integers beyond. A score among the results that fits no long is an error.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as
filled up with zeros. Ties go to the smaller id. Rows of one id and equal vectors count once, of
one id and unequal vectors ask as one query and answer each for itself; a row never answers a query
of its own id. A null id takes no part. Too few candidates give fewer
results, an empty table none. Other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import written

#: Rows of a candidate block, of a query block, and queries of a batch; lists are read this deep at first, then four times as deep.
ROWS, QUERIES, BATCH, DEPTH = 8192, 2048, 256, 32


def number_type(peaks: tuple[float, float], width: int) -> tuple[type, float | int]:
    """A type in which all sums of ``width`` products are exact, and a value below them."""
    most = float(peaks[0]) * float(peaks[1]) * max(width, 1)
    if most < 2.0**53:
        return np.float64, -np.inf
    return (np.int64, -(1 << 63)) if most < 2.0**62 and max(peaks) < 2.0**62 else (object, -np.inf)


def whole(values: np.ndarray, kind: type) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(values).astype(object) if kind is object else values.astype(kind)


class Lists:
    """A block's rows and, for every dimension, its rows by rising value. ``values`` are whole doubles."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        self.by = np.argsort(self.values, axis=0, kind="stable").astype(np.int32)
        self.peak = float(np.abs(values).max(initial=0))
        self.looked_up = 0  # scores computed

    def met(self, lo: int, hi: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Rows at places ``lo`` to ``hi`` of the lists read from above and of those read from below."""
        n = len(self.ids)
        if not up.any() and not down.any():
            return np.arange(lo, hi)
        found = np.zeros(n, bool)
        found[self.by[n - hi:n - lo, up].ravel()] = True
        found[self.by[lo:hi, down].ravel()] = True
        return np.flatnonzero(found)

    def frontier(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Last value read in every list, from above and from below."""
        at = np.arange(self.values.shape[1])
        return self.values[self.by[len(self.ids) - depth], at], self.values[self.by[depth - 1], at]

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (its row of ``q``), id and score of the k best rows for each query, in order."""
        n, kind = len(self.ids), number_type((self.peak, float(np.abs(q).max(initial=0))), q.shape[1])
        dtype, least = kind
        values, q = whole(self.values, dtype), whole(q, dtype)
        which, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        kth = np.full(len(q), least, dtype)
        active, seen, depth, step = np.arange(len(q)), np.zeros(n, bool), 0, DEPTH
        while depth < n and len(active):
            upto, part = min(n, depth + step), q[active]
            rows = self.met(depth, upto, (part > 0).any(axis=0), (part < 0).any(axis=0))
            rows = rows[~seen[rows]]
            seen[rows] = True
            if len(rows):
                found = part @ values[rows].T
                self.looked_up += found.size
                same = self.ids[rows][None, :] == own[active][:, None]
                found[same] = least
                m = min(k, len(rows))
                reach = np.maximum(kth[active], np.partition(found, len(rows) - m, axis=1)[:, len(rows) - m] if m == k else least)
                i, j = np.nonzero((found >= reach[:, None]) & ~same)
                which, ids, scores = (np.concatenate(x) for x in ((which, active[i]), (ids, self.ids[rows[j]]), (scores, found[i, j])))
                order = np.lexsort((ids, -scores, which))
                which, ids, scores = which[order], ids[order], scores[order]
                place = np.arange(len(which)) - np.searchsorted(which, which)
                which, ids, scores, place = (x[place < k] for x in (which, ids, scores, place))
                kth[which[place == k - 1]] = scores[place == k - 1]
            depth, step = upto, step * 4
            if depth < n:
                above, below = (whole(x, dtype) for x in self.frontier(depth))
                bound = np.where(part > 0, part * above, part * below).sum(axis=1)
                active = active[(bound >= kth[active]) | ~part.astype(bool).any(axis=1)]
        return which, ids, scores


def batches(q: np.ndarray) -> Iterator[np.ndarray]:
    """Queries in batches that share their strongest dimension as far as possible."""
    if not q.size:
        return
    strongest = np.abs(q).argmax(axis=1)
    order = np.lexsort((q[np.arange(len(q)), strongest] > 0, strongest))
    for lo in range(0, len(order), BATCH):
        yield order[lo:lo + BATCH]


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v (array of whole doubles) of the rows that take part, one per id and vector."""
    x = F.col("embedding")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # doubles of 2^52 and more are whole
    held = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < float(1 << 52), F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    return rows.where(good).select("vec_id", held.alias("v")).distinct()


def fits(scores: np.ndarray) -> np.ndarray:
    if any(not -(1 << 63) <= int(s) < 1 << 63 for s in (scores.min(), scores.max())) if len(scores) else False:
        raise OverflowError("an inner product among the results fits no 64-bit integer")
    return scores.astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` its ``k`` best in ``vectors``; both
    have vec_id and v."""
    n, m = vectors.count(), queries.count()
    cells, shards = max(1, -(-n // rows)), max(1, -(-m // query_rows))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    # the smaller side of the grid is a copy per block of the other, so what moves is bounded by both block sizes
    left = vectors.select(block(cells).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v", F.lit(False).alias("asks"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), block(shards).alias("shard"), "vec_id", "v", F.lit(True).alias("asks"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy()
        width = max(map(len, part["v"]), default=0)
        values = np.zeros((len(part), width))
        for i, v in enumerate(part["v"]):
            values[i, :len(v)] = v
        ids = part["vec_id"].to_numpy()
        lists, own, q = Lists(ids[~asks], values[~asks]), ids[asks], values[asks]
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        for some in batches(q):
            which, found, scores = lists.search(own[some], q[some], k)
            out.append(pd.DataFrame({"query_id": own[some][which], "vec_id": found, "score": fits(scores)}))
        return pd.concat(out)

    found = left.unionAll(right).groupBy("cell", "shard").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` against all rows."""
    rows = written(quantised(embeddings), "quantised")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
