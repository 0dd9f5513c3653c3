"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

Method: texts are grouped by their 64-bit hash and their bytes (the aggregation compares bytes, so
two texts of one hash become two entries of its chain; copies meet in the task that reads them,
before any shuffle). The directory has 2^depth slots over the leading hash bits; while a bucket is
overfull it is split by one more bit, and the directory doubles when no free bit is left. The
entries go to Parquet files of their bucket, written by the tasks that own the key ranges. The directory sends every
document to the bucket of its slot, where it finds its entry by hash and SHA-256 (the bytes were compared when the entry was formed).

Null texts count as empty; empty texts equal each other. A null id never wins against another one.
Rows that repeat an id and its text are one document given twice: they get the same result, and
all are kept if that id is, so there are no other ties. A very long text is hashed, grouped and compared whole, one row of
its task. An empty table gives an empty result. ``exact_dedup`` reads no other columns; ``kept_rows`` carries them
unchanged whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, free, scratch, written

#: Entries of a bucket before it splits; the directory has 2^16 slots at most. A bucket that is
#: overfull even then is just longer: nothing depends on its length but the size of its file.
CAPACITY, MAX_DEPTH = 1 << 16, 16


def doubled(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Directory depth and the bucket of each slot, from entries per ``max_depth``-bit prefix."""
    buckets, depth, done = [(0, 0)], 0, []  # local depth and prefix
    size = {(max_depth, p): n for p, n in counts.items()}
    for d in range(max_depth, 0, -1):
        for (k, p), n in [x for x in size.items() if x[0][0] == d]:
            size[d - 1, p >> 1] = size.get((d - 1, p >> 1), 0) + n
    while buckets:
        local, prefix = buckets.pop()
        if size.get((local, prefix), 0) <= capacity or local == max_depth:
            done.append((local, prefix))
        else:
            buckets += [(local + 1, prefix << 1), (local + 1, prefix << 1 | 1)]
            depth = max(depth, local + 1)
    slots = [0] * (1 << depth)
    for number, (local, prefix) in enumerate(sorted(done, key=lambda x: x[1] << (max_depth - x[0]))):
        lo = prefix << (depth - local)
        slots[lo:lo + (1 << (depth - local))] = [number] * (1 << (depth - local))
    return depth, slots


def leading(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


@dataclass
class Index:
    """Entries (bucket, h, sha, keep_id, group_size) in files by bucket, and the directory: bucket of every slot of ``depth`` bits."""

    entries: DataFrame
    slots: list[int]
    depth: int

    def lookup(self, rows: DataFrame, names: dict[str, str], how: str = "inner") -> DataFrame:
        """``rows``, which have columns ``names["h"]`` and ``names["sha"]``, with their entry.  The directory sends a row to its
        bucket, whose chains are walked: an entry answers if bucket, hash and digest agree."""
        spark, h = rows.sparkSession, names["h"]
        directory = spark.createDataFrame(list(enumerate(self.slots)), f"`{names['slot']}` int, `{names['bucket']}` int")  # 2^MAX_DEPTH rows at most
        sent = rows.withColumn(names["slot"], leading(F.col(f"`{h}`"), self.depth)).join(F.broadcast(directory), names["slot"]).drop(names["slot"])
        entries = self.entries.select(*[F.col(c).alias(names[c]) for c in self.entries.columns])
        return sent.join(entries, [names["bucket"], h, names["sha"]], how)


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> Index:
    """One entry per distinct text, in Parquet files by bucket."""
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    chains = docs.select("doc_id", norm.alias("norm")).withColumn("h", F.xxhash64("norm")).groupBy("h", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = written(chains.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size"), "entries")
    # at most 2^max_depth rows come to the driver
    counts = entries.groupBy(leading(F.col("h"), max_depth).alias("slot")).count().collect()
    depth, slots = doubled({r["slot"]: r["count"] for r in counts}, capacity, max_depth)
    directory = spark.createDataFrame(list(enumerate(slots)), "slot int, bucket int")
    path = scratch(spark, "index")
    (entries.withColumn("slot", leading(F.col("h"), depth)).join(F.broadcast(directory), "slot").drop("slot")
     .repartitionByRange("bucket", "h").write.partitionBy("bucket").parquet(path))
    files = spark.read.schema("h long, sha string, keep_id " + dict(entries.dtypes)["keep_id"] + ", group_size long, bucket int").parquet(path)
    return Index(files, slots, depth)


NAMES = ("bucket", "slot", "h", "sha", "keep_id", "group_size")


def keyed(docs: DataFrame, h: str, sha: str) -> DataFrame:
    """``docs`` with hash and digest of their normalised text."""
    norm = free("norm", docs.columns)
    rows = docs.withColumn(norm, ascii_lower(F.coalesce(F.col("text"), F.lit(""))))
    return rows.withColumns({h: F.xxhash64(norm), sha: F.sha2(F.col(norm).cast("binary"), 256)}).drop(norm)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    index = build_index(docs, capacity, max_depth)
    rows = index.lookup(keyed(docs.select("doc_id", "text"), "h", "sha").drop("text"), {c: c for c in NAMES})
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The input's rows and columns, without those whose text a row of larger doc_id has; names of the index give way to the
    input's."""
    index = build_index(docs, capacity, max_depth)
    index.entries = index.entries.where("group_size > 1")  # the others decide nothing
    names = {c: free(c, docs.columns) for c in NAMES}
    rows = index.lookup(keyed(docs, names["h"], names["sha"]), names, "left")
    return rows.where(F.col(names["group_size"]).isNull() | F.col("doc_id").eqNullSafe(F.col(names["keep_id"]))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
