"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

Features of a text, in two blocks.  Forms: 1- to 3-grams of its character shapes (lower case, upper case and digits become
one symbol each, other characters stay) in hashed buckets, and how many of its words repeat, in rate
classes.  Words: its lower-cased words and their 3-grams of letters in hashed buckets. Counts are log-scaled, weighted by inverse
document frequency over all documents and normalised; a truncated SVD of the labelled sample gives each block its latent space, and
a document's vector joins its normalised places in both, the words at ``WORDS`` of the forms' length. The labelled vectors, of
which there are ``sample`` at most, are broadcast. Every document's cosine with every one of them is
computed in blocks, and the labels of its ``neighbours`` nearest vote with their cosine as weight.

Null texts count as empty. A text without features, or any text if there are no labels, gets the
share of good labels in the sample (0.5 without labels). Null labels are skipped; of several labels
of one id the mean counts, of several texts the largest; of equal cosines at the last place of the
neighbourhood the smaller id votes. A very long text is counted whole, in one slice of its task. Repeated rows get repeated results,
an empty table an empty one. Ids may be numbers or strings. Input columns named ``score`` or ``predicted`` are replaced by ``score``; no others are touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, fold
from riskloom.llm.grams import document_frequencies, hashed, idf, points, slices

BITS = 10
RATES = np.array([0, 0.02, 0.1, 0.3, 0.6])
FORMS = (1 << BITS) + 32
LEXICAL = 9  # bits of the buckets of words, and of those of letters
WIDTH = FORMS + (2 << LEXICAL)
WORDS = 0.5

SHAPE = np.arange(128, dtype=np.uint32)
SHAPE[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = ord("a")
SHAPE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = ord("A")
SHAPE[[ord(c) for c in "0123456789"]] = ord("0")


def counts(text: str) -> np.ndarray:
    p = points(text)
    shapes = np.where(p < 128, SHAPE[np.minimum(p, 127)], ord("a")).astype(np.uint32)
    out = np.zeros(WIDTH, np.float32)
    out[:1 << BITS] = np.bincount(hashed(shapes, (1, 2, 3), BITS), minlength=1 << BITS)
    words = text.split()
    if n := len(words):
        lines = text.split("\n")
        own = out[1 << BITS:FORMS]
        same = sum(map(str.__eq__, words, words[1:]))
        own[np.searchsorted(RATES, same / n)] = n
        own[8 + np.searchsorted(RATES, 1 - len(set(lines)) / len(lines))] = n
        own[16 + int(7 * (1 - len(set(words)) / n))] = n
        own[24] = same
        lower = text.lower()
        kinds = Counter(lower.split())
        at = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in kinds), np.int64, len(kinds)) & (1 << LEXICAL) - 1
        out[FORMS:FORMS + (1 << LEXICAL)] = np.bincount(at, np.fromiter(kinds.values(), np.float64, len(kinds)), 1 << LEXICAL)
        out[FORMS + (1 << LEXICAL):] = np.bincount(hashed(points(lower), (3,), LEXICAL), minlength=1 << LEXICAL)
    return out


def weighed(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each block of unit length."""
    out = np.log1p(matrix) * idf
    for block in (out[:, :FORMS], out[:, FORMS:]):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    return out


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row; of equal ones the first."""
    at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, at, axis=1).min(axis=1, keepdims=True)
    tied = np.flatnonzero(np.count_nonzero(cosines >= least, axis=1) > k)
    if len(tied):
        at[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
    return np.sort(at, axis=1)


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray  # width x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, unit length
    labels: np.ndarray
    neighbours: int
    forms: int = 0  # dimensions of the forms; the others are of the words

    def place(self, matrix: np.ndarray) -> np.ndarray:
        z = weighed(matrix, self.idf) @ self.space
        if self.forms:
            for block, length in ((z[:, :self.forms], 1.0), (z[:, self.forms:], WORDS)):
                block *= length / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, matrix: np.ndarray, block: int = 2048) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        z = self.place(matrix)
        best = np.zeros((len(z), 0), np.float32)
        own = np.zeros((len(z), 0), np.float32)
        for lo in range(0, len(self.labels), block):
            near = z @ self.vectors[lo:lo + block].T
            best = np.concatenate([best, near], axis=1)
            own = np.concatenate([own, np.broadcast_to(self.labels[lo:lo + block], near.shape)], axis=1)
            if best.shape[1] > self.neighbours:
                at = nearest(best, self.neighbours)
                best, own = np.take_along_axis(best, at, axis=1), np.take_along_axis(own, at, axis=1)
        w = np.maximum(best.astype(np.float64), 0)
        total = w.sum(axis=1)
        vote = (w * own).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((total > 1e-9) & matrix.any(axis=1), np.clip(vote, 0, 1), prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, dimensions: int = 32, neighbours: int = 15) -> Model:
    """Fits on at most ``sample`` labelled rows, those with the smallest hash of their id, of the
    folds that are not held out. Document frequencies come from all documents."""
    n, df = document_frequencies(docs, counts, WIDTH)
    weights = idf(n, df)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows of two numbers: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_py() or "").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(texts.mapInArrow(run, f"doc_id {kind}, quality double, counts binary").collect())
    matrix = np.frombuffer(b"".join(r["counts"] for r in got), np.float32).reshape(len(got), WIDTH)
    good = np.array([r["quality"] for r in got], np.float32)
    if not len(got):
        return Model(weights, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), good, neighbours)
    x = weighed(matrix, weights)
    spaces = []
    for block in (x[:, :FORMS], x[:, FORMS:]):
        # the leading right singular vectors, from the Gram matrix of the features
        _, vec = np.linalg.eigh((block.T @ block).astype(np.float64))
        spaces.append(vec[:, ::-1][:, :dimensions])
    space = np.zeros((WIDTH, 2 * dimensions), np.float32)
    space[:FORMS, :dimensions], space[FORMS:, dimensions:] = spaces
    model = Model(weights, space, np.zeros((0, 0), np.float32), good, neighbours, dimensions)
    model.vectors = model.place(matrix).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The input's columns, with score and predicted (1 if score >= threshold)."""
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in fields] + ["score", "predicted"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for lo, hi in slices(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                s = own.score(np.stack([counts(t.as_py() or "") for t in b.column("text")]))
                cols = {c: b.column(c) for c in b.schema.names} | {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels, **fitting), threshold)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
