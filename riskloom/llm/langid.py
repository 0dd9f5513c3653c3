"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: 1- to 3-grams of the lower-cased code points in hashed buckets, log-scaled, weighted by
inverse document frequency over all documents that may be learned from, and normalised. Training: follow the
regularised leader, one document at a time, with elastic-net penalties; the L1 part keeps weights
of rare grams at zero. A part of the sample stays out of the training and sets the temperature
that the scores are calibrated with.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to
learn from. Rows of null lang are not learned from; of rows that repeat an id and a language the largest text
is learned. Ids may be numbers or strings. A very long text is counted whole, in one slice of its task. Equal scores go to the first language by
code point. Repeated rows get repeated results, an empty table an empty one. Other columns are not
read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fold, written
from riskloom.llm.grams import document_frequencies, hashed, idf, points, slices

BITS = 13
WIDTH = 1 << BITS
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    return np.bincount(hashed(points(text.lower()), (1, 2, 3), BITS), minlength=WIDTH)


def features(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = counts(text)
    at = np.flatnonzero(c)
    x = np.log1p(c[at]) * weights[at]
    return at.astype(np.int32), (x / max(float(np.linalg.norm(x)), 1e-9)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features and a constant x languages
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader; the last row is the constant, which has no penalty."""
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1 * penalty, 0) / ((beta + np.sqrt(n)) / alpha + l2 * penalty)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, k = rows[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            penalty = (at < width)[:, None].astype(float)
            w = weights(z[at], n[at], penalty)
            p = softmax(x @ w)
            p[k] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    penalty = np.ones((width + 1, 1))
    penalty[-1] = 0
    return weights(z, n, penalty).astype(np.float32)


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, sample: int = 6000, calibrate: float = 0.15) -> Model:
    """Fits on about ``sample`` documents, shared out evenly over the languages and chosen by a hash
    of their id, of the folds that are not held out; ``calibrate`` of them only set the temperature.

    A language gets 20 of them at least.  Rows that repeat an id and a language count as one, with the
    largest text, so that an id with any number of rows brings one row to the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "lang", "text")
    sizes = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n, df = document_frequencies(known, counts, WIDTH)
    weights = idf(n, df)
    kinds = sizes.count()
    if not kinds:
        return Model([], weights, np.zeros((WIDTH + 1, 0), np.float32), 1.0)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # `sizes` has a row per language; the sample has about `sample` rows whatever the input
    chosen = known.join(sizes, "lang").where(share * F.col("n") < F.lit(max(20.0, sample / kinds))).groupBy("doc_id", "lang").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py(), weights) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=["doc_id", "lang", "at", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(chosen.mapInArrow(run, f"doc_id {kind}, lang string, at binary, x binary").collect())
    languages = sorted({r["lang"] for r in rows})
    coded = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), languages.index(r["lang"])) for r in rows]
    held = np.random.default_rng(1).random(len(coded)) < calibrate
    w = train([r for r, h in zip(coded, held, strict=True) if not h], WIDTH, len(languages))
    model = Model(languages, weights, w, 1.0)
    checks = [r for r, h in zip(coded, held, strict=True) if h]
    if checks:
        model.temperature = calibrated(np.stack([model.logits(at, x) for at, x, _ in checks]), np.array([k for *_, k in checks]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The input's columns, with lang_pred and score."""
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in fields] + ["lang_pred", "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for lo, hi in slices(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                got = [own.predict(t.as_py()) for t in b.column("text")]
                cols = {c: b.column(c) for c in b.schema.names} | {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = fit(docs.select("doc_id", "lang", "text"), **fitting)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
