"""Fill-in-the-middle transformation with content-defined chunk memoization.

A text's tokens are ``[space]*[word]+`` or a last run of white space; two of its token boundaries cut it
into prefix, middle and suffix.  A rolling hash over the last 32 bytes ends a chunk wherever its upper
bits are zero, so that copies and shared passages fall into the same chunks whatever stands before them.
A memo gives a chunk's boundary summary (code points, ends of word runs, whether its first and last byte
belong to a word) by the hash of its content, after comparing the content itself.  The chunks' counts,
less the words that go on over a chunk's end, add up to the text's token count; their running sums name the
chunk that holds a cut, and its summary the place.

Nulls count as empty texts; empty texts are plain.  A null id is hashed as no digits.  Very long texts are
hashed in blocks; a task holds one slice of the batch (about 4 MB, or one text) with its chunks, and a memo of
bounded size.  There are no ties: every row is decided by its own id and text, so repeated rows get equal
results.  An empty table gives an empty one.  ``text`` is replaced by ``output``; input columns named like
an added one are replaced, all others pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.grams import slices

WINDOW, BITS, SMALLEST, LARGEST, BLOCK = 32, 9, 64, 8192, 1 << 18
GEAR = np.random.default_rng(0).integers(0, 1 << 32, 256, dtype=np.uint32)
MEMO_BYTES = 16_000_000
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
MARKS = (b"<P>", b"<S>", b"<M>")
ADDED = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                      T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def rolled(data: np.ndarray) -> np.ndarray:
    """At every byte, the hash of the last ``WINDOW`` bytes: the sum of their gears, each shifted by its distance."""
    h, reach = GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def chunks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of the chunks, in order."""
    lo = 0
    for at in range(0, len(data), BLOCK):
        halo = min(at, WINDOW - 1)
        ends = np.flatnonzero(rolled(data[at - halo:at + BLOCK])[halo:] >> np.uint32(32 - BITS) == 0) + (at + 1)
        for end in ends.tolist():
            while end - lo > LARGEST:
                yield lo, lo + LARGEST
                lo += LARGEST
            if end - lo >= SMALLEST:
                yield lo, end
                lo = end
    while lo < len(data):
        yield lo, min(lo + LARGEST, len(data))
        lo += LARGEST


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero(data & 0xC0 != 0x80))


class Summary:
    """What a chunk tells about its inside and its two borders."""

    __slots__ = ("content", "chars", "ends", "first", "last")

    def __init__(self, content: bytes):
        data = np.frombuffer(content, np.uint8)
        word = IS_WORD[data]
        self.content, self.chars = content, code_points(data)
        self.first, self.last = bool(word[0]), bool(word[-1])
        self.ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1

    def chars_before(self, end: int) -> int:
        return code_points(np.frombuffer(self.content, np.uint8, end))


class Memo:
    """Summaries by content hash, in two generations: a summary used in neither is forgotten."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}
        self.hits = self.misses = 0

    def summary(self, content: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(content)
        found = self.young.get(key)
        if found is not None and found.content == content:
            self.hits += 1
            return found
        found = self.old.get(key)
        if found is None or found.content != content:
            self.misses += 1
            found = Summary(content)
        else:
            self.hits += 1
        self.young[key] = found
        self.held += len(content) + 8 * len(found.ends) + 200
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        return found


class Text:
    """A text as its chunks' summaries: its token count, and the place of every cut."""

    def __init__(self, content: bytes, memo: Memo):
        data = np.frombuffer(content, np.uint8)
        bounds = list(chunks(data))
        self.parts = [memo.summary(content[lo:hi]) for lo, hi in bounds]
        self.starts = [lo for lo, _ in bounds]
        self.size = len(content)
        follows = [p.first for p in self.parts[1:]] + [False]  # whether the next chunk begins inside a word
        self.words = list(accumulate((len(p.ends) - (p.last and on) for p, on in zip(self.parts, follows, strict=False)), initial=0))
        self.chars = list(accumulate((p.chars for p in self.parts), initial=0))
        self.n = self.words[-1] + bool(self.parts and not self.parts[-1].last)

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` tokens."""
        if not k:
            return 0, 0
        if k > self.words[-1]:
            return self.size, self.chars[-1]
        i = bisect_left(self.words, k) - 1  # the chunk in which word k ends
        end = int(self.parts[i].ends[k - self.words[i] - 1])
        return self.starts[i] + end, self.chars[i] + self.parts[i].chars_before(end)


@dataclass(frozen=True)
class Rates:
    """Per cent of the texts that are cut, and of these per cent that put the suffix first."""

    cut: int = 50
    suffix_first: int = 80


def transformed(content: bytes, h: tuple[int, int, int, int], rates: Rates, memo: Memo) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = Text(content, memo)
    if not content or any(m in content for m in MARKS) or h[2] % 100 >= rates.cut:
        return text.n, "plain", None, None, content
    one, two = sorted((h[0] % (text.n + 1), h[1] % (text.n + 1)))
    (a, chars_a), (b, chars_b) = text.cut(one), text.cut(two)
    prefix, middle, suffix = content[:a], content[a:b], content[b:]
    p, s, m = MARKS
    if h[3] % 100 < rates.suffix_first:
        form, parts = "spm", (s, suffix, p, prefix, m, middle)
    else:
        form, parts = "psm", (p, prefix, s, suffix, m, middle)
    return text.n, form, chars_a, chars_b - chars_a, b"".join(parts)


def draws(doc_id: Column, seed: int) -> Column:
    """The four numbers that decide a row: 8-digit groups of a digest of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, seed: int = 42, rates: Rates = Rates()) -> DataFrame:
    """The input's columns without ``text``, with n, form, prefix_chars, middle_chars and output."""
    gone = {"text", *ADDED.names}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    own = "draws"
    while own in {f.name.lower() for f in kept}:
        own += "_"
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text"), draws(F.col("doc_id"), seed).alias(own))
    names = [f.name for f in kept] + ADDED.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for whole in batches:
            for lo, hi in slices(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                texts, numbers = b.column("text").cast(pa.binary()), b.column(own).to_pylist()
                got = [transformed(t.as_py() or b"", h, rates, memo) for t, h in zip(texts, numbers, strict=True)]
                n, form, prefix, middle, output = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(f.name) for f in kept] + [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                                                        pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*kept, *ADDED.fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from.  A cut text holds no mark, and none can
    arise across a border, so the three marks of an output are the ones that were put there."""
    parts = F.split(output, "<[PSM]>")
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digests(docs: DataFrame, **how) -> DataFrame:
    """Per document: n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs.select("doc_id", "text"), **how).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
    ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
    ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM t),
v AS (SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b FROM u),
w AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tok[1:a], '') AS p, array_to_string(tok[a + 1:b], '') AS m, array_to_string(tok[b + 1:n], '') AS s FROM v)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM w
"""
