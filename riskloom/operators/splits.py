"""Deterministic hash splits, fold ids, exact smallest-k selection and synthetic labels.

``md5(seed:key)`` is the row hash: it exists in Spark and in SQL engines, so splits can be
checked independently.  The hash split needs no shuffle; the exact smallest-k selection reads
a bounded histogram of hash prefixes (65,536 buckets) and ranks only inside the one bucket that
holds the cut, so no class or key set is ranked in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

PREFIX_HEX = 4  # 16**4 buckets


def row_hash(key: Column | str, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Row goes to test when the first 8 hex digits of its hash fall below ``test_share``."""
    cut = format(int(test_share * 16 ** 8), "08x")
    return df.withColumn(out, (F.substring(row_hash(key, seed), 1, 8) < F.lit(cut)).cast("int"))


def fold_id(df: DataFrame, key: str, folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    h = F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, (h % folds).cast("int"))


def stratified_fold(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold ids that spread every class evenly: the class's keys, by hash, take the folds in turn.
    Their ranks come from sums over hash ranges, so no class is ranked in one task."""
    keys = cut_lineage(df.select(label, key).distinct().withColumn("_h", row_hash(key, seed)).withColumn("_b", F.substring("_h", 1, PREFIX_HEX)))
    ranges = keys.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_before", F.sum("_n").over(Window.partitionBy(label).orderBy("_b")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    turn = keys.join(ranges, [label, "_b"]).select(label, key, ((rank - 1) % folds).cast("int").alias(out))
    return df.join(cut_lineage(turn), [label, key], "left")


def smallest_k(df: DataFrame, key: str, k: int, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """Rows of ``df`` (distinct keys) holding the ``k`` smallest (hash, key) per ``by`` group;
    ``k`` may be an int or a dict {by-tuple: k}."""
    h = row_hash(key, seed)
    x = df.select(*by, key).distinct().withColumn("_h", h).withColumn("_b", F.substring("_h", 1, PREFIX_HEX))
    hist = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("n")).collect()  # <= 65,536 rows per group
    groups: dict[tuple, list[tuple[str, int]]] = {}
    for r in hist:
        groups.setdefault(tuple(r[c] for c in by), []).append((r["_b"], r["n"]))
    conds = []
    for g, buckets in groups.items():
        want = k[g] if isinstance(k, dict) else k
        buckets.sort()
        acc = 0
        cut_bucket, rest = None, 0
        for b, n in buckets:
            if acc + n >= want:
                cut_bucket, rest = b, want - acc
                break
            acc += n
        in_g = F.lit(True)
        for c, v in zip(by, g):
            in_g = in_g & (F.col(c) == F.lit(v))
        if cut_bucket is None:
            conds.append((in_g, None, None))
        else:
            conds.append((in_g, cut_bucket, rest))
    take = F.lit(False)
    edge = F.lit(False)
    for in_g, b, rest in conds:
        if b is None:
            take = take | in_g
        else:
            take = take | (in_g & (F.col("_b") < F.lit(b)))
            edge = edge | (in_g & (F.col("_b") == F.lit(b)))
    base = x.where(take)
    ranked = x.where(edge).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)))
    limits = [F.when(in_g & (F.col("_b") == F.lit(b)), F.lit(rest)) for in_g, b, rest in conds if b is not None]
    lim = F.coalesce(*limits, F.lit(0)) if limits else F.lit(0)
    return base.select(*by, key).unionByName(ranked.where(F.col("_r") <= lim).select(*by, key))


def synthetic_labels(df: DataFrame, key: str, rate: float = 0.02, seed: int = 42) -> DataFrame:
    """int(n * rate) positives (n = distinct keys) chosen by the smallest hashes; the rest 0."""
    n = df.select(key).distinct().count()
    pos = smallest_k(df, key, int(n * rate), seed).withColumn("synthetic_label", F.lit(1))
    return df.join(pos, key, "left").withColumn("synthetic_label", F.coalesce("synthetic_label", F.lit(0)))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42,
                     out: str = "is_test") -> DataFrame:
    """Exact stratified split: per class, the floor(n_c * share) keys with the smallest hashes
    go to test, n_c being the class's distinct keys; all rows of a key go the same way. (The
    source rounds the whole test size up instead and shares it out over the classes.)"""
    keys = df.select(label, key).where(F.col(label).isNotNull()).distinct()
    counts = {(r[label],): r["n"] for r in keys.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {g: int(n * test_share) for g, n in counts.items()}
    test = smallest_k(keys, key, want, seed, by=[label]).withColumn(out, F.lit(1))
    return df.join(test, [label, key], "left").withColumn(out, F.coalesce(out, F.lit(0)))
