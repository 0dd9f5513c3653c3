"""BPE encoding and decoding of whole texts with a published byte-level vocabulary.

Method: the parts of a short word lie in a contiguous array, the ranks of adjacent pairs in a
second one. The smallest rank is found by a scan, the boundary under it is deleted, and the two
neighbouring ranks are refreshed, until no pair has a rank. All new words of a batch of one length
are handled as the rows of one matrix. Words over ``SHORT`` bytes keep their boundaries in a linked
list with a heap of ranks, which gives the same parts in n log n time.

Null texts count as empty, empty texts have no ids. Ties between equal ranks go to the left, as
repeated pairs of one rank do in the published encoders. Rows are independent, so repeated rows
give repeated results and an empty table gives an empty one. All input columns are kept; one
whose name is asked for as output is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published byte-level pre-tokenizer.
WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that pattern has it, and pieces of whole words between white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

SHORT = 96
CACHED = 300_000
NONE = np.int32(2**31 - 1)
_loaded: dict[str, Codec] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merge ranks and a bounded cache of encoded pieces, one per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(stand_in[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in stand_in.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        # after the last real pair a key that nothing equals
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.ranks = np.append(order.astype(np.int32), NONE)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.words = regex.compile(WORDS)
        self.split = re.compile(PIECES)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length as rows of byte ids; their parts, left-aligned, and how many."""
        n, width = ids.shape
        count = np.full(n, width)
        if width < 2 or not n:
            return ids, count
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        out, live = ids.copy(), np.arange(n)
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            go = least < NONE
            if not go.all():
                out[live[~go], : ids.shape[1]] = ids[~go]
                live, ids, ranks, at, least = live[go], ids[go], ranks[go], at[go], least[go]
            if not len(live):
                return out, count
            count[live] -= 1
            rows = np.arange(len(live))
            ids[rows, at] = self.merged[least]
            # delete the boundary: what stands right of it moves one place left
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            if ids.shape[1] < 2:
                out[live, :1] = ids
                return out, count
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), axis=1)
            for gap, own in ((at - 1, at > 0), (at, at < ids.shape[1] - 1)):
                r, g = rows[own], gap[own]
                ranks[r, g] = np.where(g + 1 < count[live[r]], self.rank(ids[r, g], ids[r, g + 1]), NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        n, first = len(ids), self.rank(ids[:-1], ids[1:])
        part, prev, after, alive = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(int(first[i]), i, part[i], part[i + 1]) for i in np.flatnonzero(first < NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[i] < n:
                prev[after[i]] = i
            for x in (prev[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (new := int(self.rank(np.array([part[x]]), np.array([part[y]]))[0])) < NONE:
                    heapq.heappush(heap, (new, x, part[x], part[y]))
        return np.array([p for p, keep in zip(part, alive, strict=True) if keep], np.int32)

    def words_of(self, piece: str) -> list[str]:
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in {".", ",", "!", "?"} and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.words.findall(piece)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Int32 ids of each distinct word, as bytes."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        done = {}
        for w in words:
            raw = w.encode("utf-8", "replace")
            if len(raw) > SHORT:
                done[w] = self.merge_long(raw).tobytes()
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for width, same in by_length.items():
            for lo in range(0, len(same), 20_000):
                part = same[lo:lo + 20_000]
                ids = self.byte_id[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)].reshape(len(part), width)
                ids, count = self.merge_rows(ids)
                raw, step = np.ascontiguousarray(ids).tobytes(), 4 * width
                for i, ((w, _), k) in enumerate(zip(part, count.tolist(), strict=True)):
                    done[w] = raw[i * step:i * step + 4 * k]
        return done

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Int32 ids of each text, as bytes."""
        docs = []
        for t in texts:
            spans = [t or ""] if self.marks is None or not any(m in (t or "") for m in self.special) else self.marks.split(t)
            docs.append([s if s in self.special else self.split.findall(s) for s in spans if s])
        spans = [s for d in docs for s in d if isinstance(s, list)]
        if len(self.cache) > CACHED:  # two generations: what is still in use moves on to the younger
            self.older, self.cache = self.cache, {}
        missing = {p for s in spans for p in s if p not in self.cache}
        kept = {p: self.older[p] for p in missing if p in self.older}
        self.cache.update(kept)
        parts = {p: self.words_of(p) for p in missing if p not in kept}
        known = self.encode_words(list({w for ws in parts.values() for w in ws}))
        fresh = {p: known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for p, ws in parts.items()}
        self.cache.update(fresh)
        get = self.cache.__getitem__
        return [b"".join(b"".join(map(get, s)) if isinstance(s, list) else np.int32(self.special[s]).tobytes() for s in d) for d in docs]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _slices(col: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` bytes or ids, so that one batch of long texts stays small."""
    lo, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(col) if not pa.types.is_list(col.type) else pc.list_value_length(col), 0).to_pylist()):
        held += n
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(col):
        yield lo, len(col)


def _replaced(batch: pa.RecordBatch, names: list[str], values: dict[str, pa.Array]) -> pa.RecordBatch:
    cols = {c: batch.column(c) for c in batch.schema.names} | values
    return pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _batches(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo, hi in _slices(whole.column(column)):
            yield whole.slice(lo, hi - lo)


def _ids(got: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the array of token ids of ``text``. ``path``: the vocabulary file on every host.

    Special tokens that a text spells out become their own id, as the published library has it when
    it adds none itself.
    """
    schema = _schema(df, out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in _batches(text, batches):
            yield _replaced(b, schema.names, {out: _ids(own.encode_batch(b.column(text).to_pylist()))})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of the token ids; special tokens stay, bytes that are no UTF-8 become
    U+FFFD, null ids count as none."""
    schema = _schema(df, out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in _batches(ids, batches):
            texts = [own.decode(x) if x else "" for x in b.column(ids).to_pylist()]
            yield _replaced(b, schema.names, {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds both columns in one pass, so that the ids cross to Python once only."""
    schema = _schema(df.drop(out), ids, T.ArrayType(T.IntegerType())).add(out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in _batches(text, batches):
            got = own.encode_batch(b.column(text).to_pylist())
            texts = [own.decode(np.frombuffer(x, np.int32).tolist()) for x in got]
            yield _replaced(b, schema.names, {ids: _ids(got), out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")).cast("binary"), 256)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_decode(docs.select("doc_id", "text"), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
