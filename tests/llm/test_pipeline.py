"""The pipeline's stages on the small tables, each against what its operator decides."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm.common import table, written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        found[name] = docs.collect()
    good, single, near, mix, coded = found.values()
    con = duckdb.connect()
    labels = dict(con.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in good}
    assert sum(labels[i] for i in texts if i in labels and i not in kept) <= 0.02 * sum(labels.values())  # clean ones stay
    assert sum(1 - labels[i] for i in kept if i in labels) <= 0.2 * sum(1 - q for q in labels.values())
    lowered = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    last = {}
    for i in sorted(kept):
        last[lowered(texts[i])] = i
    assert {r.doc_id for r in single} == set(last.values()) and len(single) == len(last)
    assert {r.doc_id for r in near} <= {r.doc_id for r in single}
    counts = {}
    for r in mix:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) == 2 and set(counts) <= {r.doc_id for r in near}
    words = {r.doc_id: len(r.text.split()) for r in near}
    total = 1.5 * sum(words.values())
    assert 0.97 * total <= sum(words[i] * n for i, n in counts.items()) <= total
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mix) and all(r.n_tokens == len(r.ids) for r in coded)
    assert columns == list(docs.columns[:len(columns)])


def test_last_stage_decodes(spark):
    docs = table(spark, SF, "documents").limit(200)
    name, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, docs, SF).collect()
    assert name == "BPE encoding and decoding" and len(got) == 200
    assert all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in got)


def test_clashing_columns_pass_through(spark):
    names = ["score", "predicted", "_id", "_copies", "_copy", "_h", "_norm", "_gone", "h", "sha", "slot", "bucket", "norm", "gone", "copies", "taken_id", "copy"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names], *[F.lit("old").alias(n) for n in ("ids", "decoded", "n_tokens")])
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    got = docs.collect()
    assert got and all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names)
    assert all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in got)
    plain = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        plain = written(stage(spark, plain, SF), "stage")
    assert sorted(r.doc_id for r in plain.collect()) == sorted(r.doc_id for r in got) and set(docs.columns) == {*columns, *names, "ids", "decoded", "n_tokens"}


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    assert docs.count() == 0
