"""Runs of bytes in a slice of texts as arrays: their places, their documents and exact codes of their contents.

For operators that work on the words or lines of many documents at once.  A run never crosses two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 1 << 62


def content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, null as empty, and where each text begins (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def places(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` within the texts that begin at ``at``."""
    size = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = at[(at > 0) & (at < size)]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def codes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Equal numbers for equal runs, and the run of each number; ``data`` holds the runs one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    runs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def joint(*columns: np.ndarray) -> np.ndarray:
    """One number per tuple of non-negative numbers, equal exactly for equal tuples."""
    out, width = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        w = int(c.max(initial=0)) + 1
        if width * w >= LIMIT:
            values, out = np.unique(out, return_inverse=True)
            width = len(values)
        out, width = out * w + c, width * w
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether another element has the same key."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
