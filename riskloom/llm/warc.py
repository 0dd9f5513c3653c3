"""WARC archives in seekable Zstandard bundles.

Method: a record is a WARC/1.1 header block and, unless it revisits another record, an HTTP response
with the payload. Records are grouped into independent Zstandard frames of about ``FRAME`` bytes and
frames into bundles of about ``BUNDLE``. After the frames a skippable frame maps record ids to frame
number, offset in the decompressed frame and length, and a second one is the seek table of the
seekable format, whose footer ends the file. Spark's own text sink commits the bundles: one row is
one file, written as the bytes it holds, and the last four of them, the footer's magic number, are
what the sink puts after a row. So no task opens a file itself, and a lost executor's files never show.

Of records with equal payloads (digest and length) of at least ``least`` bytes that of the largest page id is
the response and the others revisit it; rows that repeat that id are responses too, as are all if
every id is null, and all smaller payloads. Null html is an empty payload, a null url an empty target. A
record whose page id is null has none in its header. An empty table gives no bundle and an
empty result. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import scratch, written

FRAME, BUNDLE = 1 << 18, 8 << 20
# Fixed values of the Zstandard and seekable formats.
SKIP_INDEX, SKIP_SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed date, so that reruns write the same bytes.
DATE = "1970-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hexadecimal digits are four symbols."""
    parts = []
    for i in range(8):
        word = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(word, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # repeated payloads only; written, so that the join shuffles both sides and Spark can split a hot one
    groups = written(rows.where(F.col("payload_bytes") >= least).groupBy("sha", "payload_bytes").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, ["sha", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("sha")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    name = "" if page_id is None else f"WARC-Record-ID: <urn:page:{page_id}>\r\n"
    refers = "" if refers_to is None else f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = (f"WARC/1.1\r\nWARC-Type: {kind}\r\n{name}WARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
             f"WARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: {size}\r\n{refers}"
             f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return lines.encode("utf-8") + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; ``done`` gives the file without the last four bytes."""

    def __init__(self, level: int = 3):
        self.pack = zstandard.ZstdCompressor(level=level)
        self.out: list[bytes] = []
        self.seek: list[tuple[int, int]] = []
        self.index: list[bytes] = []
        self.frame: list[bytes] = []
        self.held = self.size = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append(struct.pack("<?qIQQ", page_id is not None, page_id or 0, len(self.seek), self.held, len(raw)))
        self.frame.append(raw)
        self.held += len(raw)
        if self.held >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = self.pack.compress(b"".join(self.frame))
            self.seek.append((len(packed), self.held))
            self.out.append(packed)
            self.size += len(packed)
            self.frame, self.held = [], 0

    def done(self) -> bytes:
        self.close_frame()
        index = b"".join(self.index)
        index = struct.pack("<II", SKIP_INDEX, len(index)) + index
        table = b"".join(struct.pack("<II", *s) for s in [*self.seek, (len(index), 0)]) + struct.pack("<IB", len(self.seek) + 1, 0)
        return b"".join(self.out) + index + struct.pack("<II", SKIP_SEEK, len(table) + 4) + table


def write_archives(records: DataFrame, path: str) -> None:
    """Bundles of the rows of ``record_types`` as files under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")), strict=True):
                row = [x.as_py() for x in row]
                bundle.add(row[0], record(*row))
                if bundle.size >= BUNDLE:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.done()], pa.binary())], names=["value"])
                    bundle = Bundle()
        if bundle.index:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.done()], pa.binary())], names=["value"])

    # binary to string keeps the bytes as they are
    bundles = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    ending = struct.pack("<I", FOOTER).decode("latin-1")
    bundles.write.option("lineSep", ending).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, packed and unpacked size of every frame, from the end of the file."""
    count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != FOOTER:
        raise ValueError("no seek table at the end of the bundle")
    at, out = len(data) - 9 - 8 * count, []
    sizes = list(struct.iter_unpack("<II", data[at:len(data) - 9]))
    start = 0
    for packed, whole in sizes:
        out.append((start, packed, whole))
        start += packed
    return out


def record_index(data: bytes) -> list[tuple[int | None, int, int, int]]:
    """Record id, frame, offset in the frame and length of every record."""
    start, packed, _ = seek_table(data)[-1]
    magic, size = struct.unpack_from("<II", data, start)
    if magic != SKIP_INDEX or size + 8 != packed:
        raise ValueError("no record index in the bundle")
    rows = struct.iter_unpack("<?qIQQ", data[start + 8:start + packed])
    return [(page if known else None, frame, offset, length) for known, page, frame, offset, length in rows]


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, whole = frame
    return zstandard.ZstdDecompressor().decompress(data[start:start + packed], max_output_size=whole)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def page_of(field: str | None) -> int | None:
    return None if field is None else int(field.removeprefix("<urn:page:").removesuffix(">"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to,
    file, frame, offset, length of every record, the last four from the bundle's index."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")  # an empty table leaves an empty file
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "frame", "offset", "length"]
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, frame int, offset long, length long"
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        frames, now, text = seek_table(data), -1, b""
        for page, frame, offset, length in record_index(data):
            if frame != now:
                now, text = frame, read_frame(data, frames[frame])
            fields, payload = parse(text[offset:offset + length])
            kind = fields["WARC-Type"]
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of page {page} in {file} does not have its digest")
            yield page, fields["WARC-Target-URI"], payload if kind == "response" else None, int(fields["X-Payload-Length"]), digest, kind, page_of(fields.get("WARC-Refers-To")), file, frame, offset, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0), b.column(1), strict=True):
                held, size = [], 0
                for r in rows(file.as_py(), data.as_py()):
                    held.append(r)
                    size += r[-1]
                    if size >= BUNDLE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes every page and reads the archives back: the columns of ``read_archives``."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    records = record_types(pages.select("page_id", "url", "html"), least)
    write_archives(records, path)
    return read_archives(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(h, 1 + CAST(floor(i / 4) AS INT) * 5, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
