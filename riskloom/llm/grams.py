"""Hashed n-gram counts for the two text classifiers, and the work on slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = np.uint32(2654435761)


def points(text: str) -> np.ndarray:
    """Code points as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of every n-gram of ``codes`` (uint32) of the given sizes, in 2^bits buckets."""
    out, run = [], codes
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(codes) < n:
                break
            run = run[:-1] * MIX + codes[n - 1:]
        if n in sizes:
            h = (run ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * MIX
            out.append((h ^ h >> np.uint32(15)) * MIX >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def slices(texts: pa.Array, rows: int = 2000, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows that end once their texts reach ``size`` bytes."""
    lo, held = 0, 0
    for i in range(len(texts)):
        held += texts[i].as_buffer().size if texts[i].is_valid else 0
        if held >= size or i + 1 - lo >= rows:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def document_frequencies(docs: DataFrame, counts, width: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that have each feature; ``counts``: text to a vector of ``width``.

    Every task sends one row per feature, so the shuffle and the result do not grow with the texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                total[:-1] += counts(t.as_py() or "") > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(total)], names=["i", "n"])

    rows = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    got = np.zeros(width + 1, np.int64)
    for r in rows:
        got[r["i"]] = r["n"]
    return int(got[-1]), got[:-1]


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
