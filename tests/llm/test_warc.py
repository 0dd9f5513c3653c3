"""Archives: exact round trip, random access by the index, revisits."""

import base64
import hashlib
import os

import zstandard

from riskloom.llm import warc
from riskloom.llm.common import scratch

SCHEMA = "page_id long, url string, html string, sha string"


def test_round_trip_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    pages = [(i, f"http://x/{i}", ("é page %d " % (i % 40)) * (i % 13), "clash") for i in range(200)]
    pages += [(500, None, None, None), (501, "u\r\nv", "", None), (None, "n", "only", None), (502, "long", "x" * 300_000, None)]
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    path = scratch(spark, "warc")
    warc.write_archives(warc.record_types(df), path)
    got = warc.read_archives(spark, path).collect()
    by_payload = {}
    for i, _, text, _ in pages:
        by_payload.setdefault(text or "", []).append(i)
    assert len(got) == len(pages)
    for r in got:
        text = next(t or "" for i, _, t, _ in pages if i == r.page_id)
        raw = text.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = max((i for i in by_payload[text] if i is not None), default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    # one record by file, frame and offset, without reading the rest
    r = max(got, key=lambda r: r.payload_bytes if r.payload else 0)
    data = open(r.file.removeprefix("file:"), "rb").read()
    frame = warc.read_frame(data, warc.seek_table(data)[r.frame])
    assert warc.parse(frame[r.offset:r.offset + r.length])[1] == bytes(r.payload)
    # every frame is a frame of its own, and a plain reader gets all records
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == sum(x.file == r.file for x in got)
    assert not [f for f in os.listdir(path.removeprefix("file://")) if f.startswith("_temporary")]


def test_least_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "same", ""), (2, "b", "same", ""), (2, "b", "same", ""), (None, "c", "z", ""), (None, "d", "z", "")], SCHEMA)
    kinds = lambda least: sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.archive(df, least).collect())
    assert kinds(0) == [("1", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"), ("None", "response", "None"), ("None", "response", "None")]
    assert {k for _, k, _ in kinds(5)} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0
