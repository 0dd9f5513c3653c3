"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints: each of the 64 bits is the majority of that bit over the XXH64 hashes of a text's word
shingles. Candidates: equal fingerprints are one node; the 64 bits are cut into blocks, and two
fingerprints within the radius agree in all but ``radius`` blocks, so every choice of the others is
a table whose groups hold all links (the number of blocks follows the number of nodes). A group's
fingerprints lie as bit planes, one bit per lane; distances to the lane ``s`` further on are added up
plane by plane in carry-save counters over all lanes, and the block is abandoned once every lane has
passed the radius. A group beyond ``GROUP`` nodes is dealt out as pairs of parts, so no group is compared
in one task. Tasks send on the links that join two of their sets; components are then found by
alternating large and small stars.

Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. A null id
never is a component's smallest. Rows that repeat an id and its text get the same result; an empty
table gives an empty one. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, written

BITS = 64
#: Nodes of a part, and lanes that are compared at once.
GROUP, LANES = 1024, 1 << 16


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    words = raw.lower().split()  # on bytes: A-Z and the six white-space characters of ASCII
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        text = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1:], strict=False)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def as_planes(values: np.ndarray) -> list[int]:
    """The values' bits as one integer per bit position, with one lane per value."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [as_int(bits[:, j]) for j in range(BITS)]


def as_int(lanes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(lanes, bitorder="little").tobytes(), "little")


def close(values: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` bits of each other; the values of a group stand together."""
    at = np.arange(len(values))
    ends = np.repeat(np.cumsum(sizes), sizes)
    planes, width = as_planes(values), len(values)
    digits = radius.bit_length()
    start = (1 << digits) - radius - 1  # so that the counter runs over at radius + 1
    for s in range(1, int(sizes.max(initial=0))):
        inside = np.arange(len(at)) + s < ends
        if inside.sum() * 4 < len(at):  # groups that are through leave
            stay = np.isin(ends, ends[inside])
            ends = np.cumsum(stay)[ends - 1][stay]
            at, inside = at[stay], inside[stay]
            planes, width = as_planes(values[at]), len(at)
        full = (1 << width) - 1
        over = full ^ as_int(inside)
        counter = [full if start >> k & 1 else 0 for k in range(digits)]
        for plane in planes:
            carry = plane ^ (plane >> s)
            for k in range(digits):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if over & full == full:
                break
        else:
            left = full & ~over
            lanes = np.flatnonzero(np.unpackbits(np.frombuffer(left.to_bytes((width + 7) // 8, "little"), np.uint8), bitorder="little"))
            yield at[lanes], at[lanes + s]


def joined(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links, those that join two sets: a forest with the same components."""
    root = np.arange(len(values))
    out: list[tuple[int, int]] = []
    for a, b in close(values, sizes, radius):
        new = root[a] != root[b]
        if not new.any():
            continue
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            while root[y] != y:
                root[y] = root[root[y]]
                y = int(root[y])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((x, y))
        while (root[root] != root).any():
            root = root[root]
    ends = np.array(out, np.int64).reshape(-1, 2)
    return values[ends[:, 0]], values[ends[:, 1]]


def masks(n: int, radius: int) -> list[int]:
    """Bit masks such that two values within the radius agree under one of them; about 16 of ``n``
    random values, or fewer, share a key."""
    blocks = radius + 1
    while (BITS // blocks) * (blocks - radius) < math.log2(max(n, 2)) - 4 and blocks < BITS // 2:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - radius)]


def links(nodes: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) that have the components of all links."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(nodes.count(), radius)]
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed))))
    rows = nodes.select("fp", keys.alias("k")).select("k.t", "k.key", "fp")
    # few keys are that large, and Spark sends their table around only while its file is small
    large = written(rows.groupBy("t", "key").count().where(F.col("count") > group), "large-keys")
    rows = rows.join(large, ["t", "key"], "left")
    parts = F.ceil(F.col("count") / group).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    pairs = F.when(F.col("count").isNotNull(), F.filter(others, lambda x: x["i"] != x["j"])).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    rows = rows.select("t", "key", F.explode(pairs).alias("p"), "fp").select("t", "key", "p.i", "p.j", "fp")
    # a group of one has no partner, and most are
    by = ["t", "key", "i", "j"]
    rows = rows.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            cols = [table.column(c).to_numpy() for c in by]
            fp = table.column("fp").to_numpy().view(np.uint64)
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(fp) else np.zeros(0, np.int64)
            stop = len(fp) if last or not len(change) else int(change[-1])
            if not last and not len(change):
                return None, table
            bounds = np.concatenate([[0], change[change < stop], [stop]])
            sizes = np.diff(bounds)
            order = np.argsort(sizes, kind="stable")  # groups of like size side by side
            order = order[sizes[order] > 1]
            a, b = [], []
            first = np.cumsum(sizes[order]) // LANES
            for block in np.unique(first):
                own = order[first == block]
                index = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in own])
                x, y = joined(fp[index], sizes[own], radius)
                a.append(x), b.append(y)
            x = np.concatenate(a or [np.zeros(0, np.uint64)]).view(np.int64)
            y = np.concatenate(b or [np.zeros(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"]), table.slice(stop)

        rest = None
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < LANES:
                continue
            out, rest = flush(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            if out is not None:
                yield out
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks(), True)[0]

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (a, b); a != b.

    A round sends every node's larger neighbours to its smallest one (large star), then the smaller ones
    (small star). When nothing changes, every node points to its root. The smallest neighbours are
    written before they are joined, so that both sides of the join are shuffled and Spark can split a hub.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))

    def marks(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = marks(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.where("v > u").join(smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)  # every pair points from the larger node to the smaller one
        small = large.join(smallest(large), "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(small.where("a != b").distinct())
        after = marks(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, group))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    ids = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = written(named.join(ids, "root").select("fp", "component_id"), "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
