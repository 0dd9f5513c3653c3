"""Exact groups against a dictionary, and the directory of the index."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from riskloom.llm import exact

SCHEMA = "doc_id long, text string, h string, sha string, keep_id string"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_groups(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.choice(["Same Text", "same text", "É", "é", None, "", f"own {i}", "KK"])) for i in range(300)]
    rows += [(5, "Same TEXT"), (None, "lonely"), (None, "same text"), (400, "x" * 500_000), (401, "X" * 500_000)]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in rows:
        own = groups[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((str(i), str(keep), len(own), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    for capacity in (4, 1 << 16):
        got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(df, capacity).collect()]
        assert sorted(got) == sorted(want)
    kept = exact.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])
    assert exact.exact_dedup(df.limit(0)).count() == 0


def test_directory_doubles():
    depth, slots = exact.doubled({0: 10, 1: 3, 8: 1, 15: 2}, capacity=5, max_depth=4)
    assert depth == 4 and len(slots) == 16 and slots[0] != slots[1]
    assert len({slots[p] for p in (8, 15)}) == 1  # halves that fit stay one bucket
    assert exact.doubled({}, 5, 4) == (0, [0])
    rnd = random.Random(1)
    counts = {p: rnd.randrange(1, 9) for p in rnd.sample(range(256), 120)}
    depth, slots = exact.doubled(counts, 20, 8)
    load = {}
    for p, n in counts.items():
        load[slots[p >> (8 - depth)]] = load.get(slots[p >> (8 - depth)], 0) + n
    assert max(load.values()) <= 20


def test_index_is_on_shared_files(spark):
    df = spark.createDataFrame([(i, f"t{i}", "", "", "") for i in range(200)], SCHEMA)
    index = exact.build_index(df, capacity=20)
    per = index.entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.lpad(F.hex("h"), 16, "0")).alias("lo"), F.max(F.lpad(F.hex("h"), 16, "0")).alias("hi")).orderBy("lo").collect()
    assert max(r.n for r in per) <= 20 and sum(r.n for r in per) == 200
    assert all(a.hi < b.lo for a, b in zip(per, per[1:], strict=False))  # a bucket is a range of keys


def test_documents_go_where_the_directory_says(spark):
    df = spark.createDataFrame([(i, f"t{i % 150}", "", "", "") for i in range(200)], SCHEMA)
    index = exact.build_index(df, capacity=20)
    rows = exact.keyed(df.select("doc_id", "text"), "h", "sha")
    names = {c: c for c in exact.NAMES}
    assert index.depth > 1 and index.lookup(rows, names).count() == 200
    index.slots = index.slots[1:] + index.slots[:1]  # another bucket for every slot: few find an entry
    assert index.lookup(rows, names).count() < 150
    index.slots = [max(index.slots) + 1] * len(index.slots)
    assert index.lookup(rows, names).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = exact.exact_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(exact.SQL).fetchall())
