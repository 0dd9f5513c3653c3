"""Mixing sources to target weights by weighted fair queueing.

Method: within its source a document's place comes from a hash of its id. Its virtual finish time is
the number of its source's words up to its end, divided by the source's target; a source whose target
exceeds its size goes round a second time in the same order. All passes are ordered by finish time
over all sources and taken while their words fit the total budget, the sum of the targets.

A running sum never has a whole source in one task: hash ranges of a source are summed first, and the
finish times, of which each unit holds the same number of words, are cut into equal ranges.  The sums of the ranges are themselves
range-sorted, and run on from what stands before their partition.

Null texts and texts without words have size 0 and nothing is taken of them. The null source is a source
of its own, the last one. Equal finish times go by source, hash, id and size; rows that repeat an id
follow each other, whatever else they hold. A null id counts as empty text. Sources of no words
have target 0, an empty table gives an empty result. Other columns are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, running, written

WEIGHTS, BUDGET, REPEATS = (5, 2, 1), 1.5, 2
#: Documents of a range, on average.
RANGE = 1024


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS) -> DataFrame:
    """rn, source, source_size, weight, target; one row per source, and one row of sums on the driver.

    Raising one water level until the budget is shared out is where resharing the excess ends: sources in
    the order in which they fill up, and the level once those before are full.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    s = running(s, [F.col("source").asc_nulls_last()], {"rn": "one"}).drop("one").withColumn("rn", F.col("rn").cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = written(s.withColumn("_most", F.col("source_size") * repeats), "sources")
    all_ = s.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    most = F.col("_most")
    s = running(s, [most / F.col("weight"), F.col("rn")], {"_full": "_most", "_fw": "weight"})
    s = s.withColumns({"_full": F.col("_full") - most, "_fw": F.col("_fw") - F.col("weight")})
    s = s.withColumn("_level", (F.lit((all_["t"] or 0) * float(budget)) - F.col("_full")) / (F.lit(all_["w"]) - F.col("_fw")))
    # the level at the first source that it does not fill; counting more sources as full only lowers it, and
    # beyond all of them every source is full
    level = s.agg(F.max(F.when(F.col("_level") <= most / F.col("weight"), F.col("_level")))).first()[0]
    target = most.cast("double") if level is None else F.least(most.cast("double"), F.lit(level) * F.col("weight"))
    return s.select("rn", "source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, finish (of the first pass, null if there is none), copies, taken."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("r")), "sizes")
    plan = written(targets(sizes, weights, budget, repeats), "targets")
    total, n = plan.agg(F.sum("target"), F.lit(1)).first()[0] or 0.0, sizes.count()
    ranges = max(1, n // RANGE)

    # one row per source in `plan`, so that Spark broadcasts it while its file is small
    rows = sizes.withColumn("_k", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(
        plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_k"), "rn", "source_size", "target"), "_k").drop("_k")
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("r", 1, 8), 16, 10).cast("long") * ranges / 2**32))
    words = running(rows.groupBy("rn", "b").agg(F.sum("size").alias("words")), [F.col("rn"), F.col("b")], {"upto": "words"})
    words = written(words.withColumn("offset", F.col("upto") - F.col("words")).select("rn", "b", "offset"), "offsets")
    start = written(words.groupBy("rn").agg(F.min("offset").alias("start")), "starts")  # a row per source
    offsets = words.join(start, "rn").select("rn", "b", (F.col("offset") - F.col("start")).alias("offset"))
    within = Window.partitionBy("rn", "b").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(within)).join(offsets, ["rn", "b"])
    rows = written(rows.withColumn("end", F.col("end") + F.col("offset")).drop("offset", "b"), "ends")

    passes = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    order = ["finish", "rn", "r", "doc_id", "size", "pass"]
    items = rows.where("size > 0 and target > 0").select("*", passes.alias("pass")).withColumn(
        "finish", (F.col("end") + F.col("pass") * F.col("source_size")) / F.col("target"))
    items = items.select(*order, F.floor(F.col("finish") * ranges).alias("b"))
    sums = running(items.groupBy("b").agg(F.sum("size").alias("words")), [F.col("b")], {"upto": "words"})
    edge = sums.where(F.col("upto") > total).orderBy("b").limit(1).first()
    if edge is None:
        copies = F.when((F.col("size") > 0) & (F.col("target") > 0), repeats).otherwise(0)
    else:
        run = F.sum("size").over(Window.partitionBy("b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        last = items.where(F.col("b") == edge["b"]).withColumn("run", run + (edge["upto"] - edge["words"])).where(
            F.col("run") <= total).orderBy("run", ascending=False).limit(1).first()
        copies = F.lit(0)
        for p in range(repeats):
            finish = (F.col("end") + F.lit(p) * F.col("source_size")) / F.col("target")
            if last is None:
                ok = finish < F.lit(edge["b"]) / ranges
            else:
                kinds = ["double", "int", "string", "long", "long", "int"]
                mine = [finish, F.col("rn"), F.col("r"), F.coalesce("doc_id", F.lit(-2**63)), F.col("size"), F.lit(p)]
                edges = [*last[:3], -2**63 if last["doc_id"] is None else last["doc_id"], *last[4:6]]
                ok = F.struct(*(c.cast(k).alias(f"c{i}") for i, (c, k) in enumerate(zip(mine, kinds, strict=True)))) <= F.struct(
                    *(F.lit(x).cast(k).alias(f"c{i}") for i, (x, k) in enumerate(zip(edges, kinds, strict=True))))
            copies = copies + F.when((F.col("size") > 0) & (F.col("target") > 0) & ok, 1).otherwise(0)
    out = rows.withColumn("copies", copies.cast("int"))
    finish = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("end") / F.col("target"))
    return out.select("doc_id", "source", "size", "source_size", "target", finish.alias("finish"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS r FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((rn - 1) % 3 + 1 AS INT)] AS weight FROM s),
f AS (SELECT *, CAST(source_size * 2 AS DOUBLE) / weight AS ratio,
             CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS t, sum(weight) OVER () AS ws FROM w),
g AS (SELECT *, coalesce(sum(source_size * 2) OVER b, 0) AS full_words, coalesce(sum(weight) OVER b, 0) AS full_weight FROM f
      WINDOW b AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (t - CAST(full_words AS DOUBLE)) / CAST(ws - full_weight AS DOUBLE) AS lvl FROM g),
p AS (SELECT rn, source, source_size, coalesce(least(CAST(source_size * 2 AS DOUBLE), max(CASE WHEN lvl <= ratio THEN lvl END) OVER () * weight),
             CAST(source_size * 2 AS DOUBLE)) AS target FROM l),
e AS (SELECT d.*, p.rn, p.source_size, p.target,
             sum(size) OVER (PARTITION BY rn ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
i AS (SELECT *, CAST(fin + k * source_size AS DOUBLE) / target AS finish FROM e, (VALUES (0), (1)) AS v(k) WHERE size > 0 AND target > 0),
c AS (SELECT doc_id, source, size, k, sum(size) OVER (ORDER BY finish, rn, r, doc_id, size, k ROWS UNBOUNDED PRECEDING) AS run FROM i),
x AS (SELECT doc_id, sum(size) AS taken FROM c WHERE run <= (SELECT sum(target) FROM p) GROUP BY doc_id)
SELECT e.doc_id, CAST(e.size AS BIGINT) AS size, e.source_size, e.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken
FROM e LEFT JOIN x ON e.doc_id = x.doc_id
"""
