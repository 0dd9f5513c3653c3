"""Signal features over a table (signal_id, samples ARRAY<FLOAT>) partitioned across executors.

RMS and zero-crossing statistics are native higher-order array functions (JVM) over frames of ``frame`` samples every
``hop`` samples, without padding; a signal shorter than one frame is one frame of its own length.  The spectral
features, MFCC and pitch, and the time statistics that go with them, run in ``mapInPandas`` stages with NumPy FFTs over
centred, padded frames: Slaney's mel bank of unit area, decibels with a floor 80 below the signal's peak,
peaks interpolated by a parabola.  Padding is with zeros, or by reflection (``pad="reflect"``).  An empty signal gets
default zeros and an error flag.  Signals of any length: long ones are worked on in chunks of frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import stored

DEFAULT_RATE = 22050
#: Frames of a chunk: 524,288 samples at the default hop, 24 seconds at the default rate.
CHUNK_FRAMES = 1024
STATS = ("mean", "std", "min", "max")


def _frames(x: Column, frame: int, hop: int, lead: Column | int = 0):
    """Length, frame length and frame starts of the samples behind the first ``lead`` ones."""
    n = F.size(x) - lead
    flen = F.least(n, F.lit(frame))
    starts = F.when(n >= frame, F.sequence(F.lit(0), n - frame, F.lit(hop))).otherwise(F.array(F.lit(0)))
    return n, flen, F.transform(starts, lambda s: s + lead)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: inside a lambda over an array, Spark
    would otherwise evaluate its expression for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rms_values(x: Column, frame: int = 2048, hop: int = 512, lead: Column | int = 0) -> Column:
    n, flen, starts = _frames(x, frame, hop, lead)
    return F.when(n > 0, F.transform(starts, lambda s: F.sqrt(
        F.aggregate(F.slice(x, s + 1, flen), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / flen)))


def zcr_values(x: Column, frame: int = 2048, hop: int = 512, lead: Column | int = 0) -> Column:
    n, flen, starts = _frames(x, frame, hop, lead)
    crossing = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), lambda i: F.when(i == 0, F.lit(0)).when(
        (F.get(x, i) >= 0) != (F.get(x, i - 1) >= 0), F.lit(1)).otherwise(F.lit(0)))
    return F.when(n > 0, once(crossing, lambda x: F.transform(starts, lambda s: F.aggregate(
        F.slice(x, s + 1, flen), F.lit(0), lambda a, v: a + v).cast("double") / flen)))


# ---- signals cut into chunks of frames ---------------------------------------------------
# A part is (n, mean, m2, lo, hi) of the frame values of one chunk: m2 is the sum of squared deviations from the mean.

PART = "array<struct<n: bigint, mean: double, m2: double, lo: double, hi: double>>"


def _part_of(vals: Column) -> Column:
    k = F.size(vals).cast("bigint")
    mean = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / k
    m2 = once(mean, lambda m: F.aggregate(vals, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
    return F.array(F.struct(k.alias("n"), mean.alias("mean"), m2.alias("m2"), F.array_min(vals).alias("lo"), F.array_max(vals).alias("hi"))).cast(PART)


def _stats_of(part: Column, name: str) -> list[Column]:
    """Mean, population std, min and max of a part; zeros for no value."""
    some = part["n"] > 0
    cols = (part["mean"], F.sqrt(part["m2"] / part["n"]), part["lo"], part["hi"])
    return [F.coalesce(F.when(some, c), F.lit(0.0)).alias(f"{name}_{s}") for c, s in zip(cols, STATS, strict=True)]


def _merged(parts: DataFrame, row: str, carry: list[Column]) -> DataFrame:
    """Parts of the chunks of a signal (arrays in column ``parts``) as one array per signal.

    Deviations are merged around the signal's mean, so nearly equal values lose no digits.  A signal has a row per chunk
    and feature here, whatever its number of samples."""
    x = parts.select(row, "chunk", F.posexplode("parts").alias("_f", "_p")).select(row, "_f", "_p.*")
    by = Window.partitionBy(row, "_f")
    n = F.sum("n").over(by)
    x = x.withColumn("_mean", F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))).over(by) / F.when(n > 0, n))
    off = F.col("mean") - F.col("_mean")
    per = x.groupBy(row, "_f").agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = per.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("_f", "n", "mean", "m2", "lo", "hi"))).alias("_a"))  # one element per feature
    whole = whole.select(row, F.transform("_a", lambda a: F.struct(a["n"].alias("n"), a["mean"].alias("mean"), a["m2"].alias("m2"), a["lo"].alias("lo"), a["hi"].alias("hi"))).cast(PART).alias("parts"))
    return parts.groupBy(row).agg(*carry).join(whole, row)


def _pieces(df: DataFrame, id_col: str, samples: str, chunks: Column, span) -> DataFrame:
    """A row per chunk of a signal: _row (one number per input row), id, n samples, chunk, from (first sample) and piece;
    ``span(chunk)`` gives first sample and end.  The pieces are cut in one projection and dealt out by (_row, chunk)."""
    n = F.size(samples)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), n.alias("_n"), F.transform(
        F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(c.alias("chunk"), span(c)[0].alias("from"), F.slice(samples, span(c)[0] + 1, span(c)[1] - span(c)[0]).alias("piece"))).alias("_c"))
    rows = rows.select("_row", id_col, "_n", F.explode("_c").alias("_c")).select("_row", id_col, "_n", "_c.*")
    # few bytes, much work: a fixed number of partitions, which adaptive execution does not put together
    return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row", "chunk")


def _frame_stats(df: DataFrame, id_col: str, samples: str, values, prefix: str, frame: int, hop: int, chunk_frames: int) -> DataFrame:
    """Statistics of frame values.  Signals of up to ``chunk_frames`` frames stay in their task; the frames of
    longer ones are dealt out in chunks with the one sample before them, and the chunks' moments merged."""
    n = F.coalesce(F.size(samples), F.lit(-1))
    frames = F.when(n >= frame, F.floor((n - frame) / hop) + 1).otherwise(1)
    chunks = F.ceil(frames / chunk_frames).cast("int")
    short = df.where(chunks <= 1).select(id_col, F.get(_part_of(values(F.col(samples), frame, hop)), F.lit(0)).alias("_p"))

    def span(c: Column) -> tuple[Column, Column]:
        first = c * (chunk_frames * hop)
        return F.greatest(first - 1, F.lit(0)), F.least(first + (chunk_frames - 1) * hop + frame, n)

    pieces = _pieces(df.where(chunks > 1), id_col, samples, chunks, span)
    lead = F.when(F.col("chunk") > 0, 1).otherwise(0)
    parts = pieces.select("_row", id_col, "chunk", _part_of(values(F.col("piece"), frame, hop, lead)).alias("parts"))
    long = _merged(parts, "_row", [F.any_value(id_col).alias(id_col)]).select(id_col, F.get("parts", F.lit(0)).alias("_p"))
    return short.unionByName(long).select(id_col, *_stats_of(F.col("_p"), prefix))


def signal_rms_stats(df: DataFrame, id_col: str, samples: str, frame: int = 2048, hop: int = 512, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Frame RMS energy: mean, population std, min, max (0 for an empty signal)."""
    return _frame_stats(df, id_col, samples, rms_values, "rms", frame, hop, chunk_frames)


def signal_zcr_stats(df: DataFrame, id_col: str, samples: str, frame: int = 2048, hop: int = 512, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Frame zero-crossing rate (zero counts as positive): mean, population std, min, max."""
    return _frame_stats(df, id_col, samples, zcr_values, "zcr", frame, hop, chunk_frames)


def signal_profile(df: DataFrame, id_col: str, samples: str, rate: int = DEFAULT_RATE) -> DataFrame:
    n = F.coalesce(F.size(samples), F.lit(0))
    n = F.when(n < 0, F.lit(0)).otherwise(n)
    return df.select(id_col, n.alias("n_samples"), (n / F.lit(float(rate))).alias("duration"),
                     F.lit(rate).alias("sample_rate"), (n == 0).cast("int").alias("audio_processing_error"))


def signal_validity(df: DataFrame, id_col: str, samples: str, rate: int = DEFAULT_RATE) -> DataFrame:
    """Valid when the signal exists and its first second holds samples; the reason otherwise."""
    n = F.coalesce(F.size(samples), F.lit(0))
    n = F.when(n < 0, F.lit(0)).otherwise(n)
    first = F.least(n, F.lit(rate))
    return df.select(id_col, n.alias("n_samples"),
                     (F.col(samples).isNotNull() & (first > 0)).cast("int").alias("is_valid"),
                     F.when(F.col(samples).isNull(), "missing").when(n == 0, "empty").alias("reject_reason"))


# ---- spectral stage (mapInPandas) -------------------------------------------------------

def feature_names(n_mfcc: int = 13) -> list[str]:
    names = [f"mfcc_{i}_{s}" for i in range(n_mfcc) for s in STATS]
    names += [f"{f}_{s}" for f in ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "zcr") for s in STATS]
    names += [f"{f}_{s}" for f in ("rms", "pitch") for s in STATS]
    return names


def output_schema(id_field: T.StructField, n_mfcc: int = 13) -> T.StructType:
    return T.StructType([id_field] + [T.StructField(n, T.DoubleType()) for n in feature_names(n_mfcc)]
                        + [T.StructField("duration", T.DoubleType()), T.StructField("sample_rate", T.IntegerType()),
                           T.StructField("audio_processing_error", T.IntegerType())])


def mel_scale(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear up to 1,000 Hz (15 mel), then 27 mel per factor of 6.4."""
    return np.where(hz < 1000.0, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1000.0) / 1000.0) * 27 / np.log(6.4))


def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles at equal steps of the mel scale, each of area one (in Hz)."""
    freqs = np.fft.rfftfreq(n_fft, 1.0 / rate)
    mels = np.linspace(0.0, float(mel_scale(np.array(rate / 2))), n_mels + 2)
    edges = np.where(mels < 15, mels * 200 / 3, 1000.0 * np.exp((mels - 15) * np.log(6.4) / 27))
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    triangles = np.maximum(0.0, np.minimum((freqs - lo) / (mid - lo), (hi - freqs) / (hi - mid)))
    return triangles * 2 / (hi - lo)


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    m = np.cos(np.pi * np.arange(n_out)[:, None] * (2 * np.arange(n_in) + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    m[0] /= np.sqrt(2.0)
    return m


@dataclass
class Spectra:
    """The frames of a signal are centred on every ``hop``-th sample, the signal padded by half a frame on both sides."""

    rate: int = DEFAULT_RATE
    n_fft: int = 2048
    hop: int = 512
    n_mfcc: int = 13
    n_mels: int = 128
    pad: str = "constant"
    chunk_frames: int = CHUNK_FRAMES

    def __post_init__(self):
        if self.pad not in ("constant", "reflect"):
            raise ValueError(f"unknown padding: {self.pad}")
        self.half = self.n_fft // 2
        self.window = np.hanning(self.n_fft + 1)[:-1]
        self.freqs = np.fft.rfftfreq(self.n_fft, 1.0 / self.rate)
        self.bank = mel_bank(self.rate, self.n_fft, self.n_mels)
        self.dct = dct_matrix(self.n_mfcc, self.n_mels)

    def framed(self, piece: np.ndarray, at: int, n: int, chunk: int, pad: str) -> np.ndarray:
        """The chunk's frames; ``piece`` is the part of the ``n`` samples that begins at sample ``at``."""
        first = chunk * self.chunk_frames
        count = min(self.chunk_frames, n // self.hop + 1 - first)
        where = np.arange(first * self.hop - self.half, (first + count - 1) * self.hop - self.half + self.n_fft)
        inside = (where >= 0) & (where < n)
        if pad == "reflect" and n > 1:
            where = where % (2 * n - 2)
            where = np.minimum(where, 2 * n - 2 - where)
        else:
            where = np.clip(where, 0, n - 1)
        y = piece[where - at]
        if pad == "constant":
            y = np.where(inside, y, 0.0)
        return np.lib.stride_tricks.sliding_window_view(y, self.n_fft)[::self.hop]

    def magnitudes(self, piece: np.ndarray, at: int, n: int, chunk: int) -> np.ndarray:
        return np.abs(np.fft.rfft(self.framed(piece, at, n, chunk, self.pad) * self.window, axis=1))

    def decibels(self, spec: np.ndarray) -> np.ndarray:
        return 10.0 * np.log10(np.maximum(spec**2 @ self.bank.T, 1e-10))

    def pitch(self, spec: np.ndarray) -> np.ndarray:
        """Frequency of the strongest peak of each frame that has one, from a parabola through the peak and its neighbours.

        A peak lies between 150 and 4,000 Hz, exceeds its lower and reaches its upper neighbour, and is over a tenth of
        its frame's largest magnitude; its strength is the parabola's top."""
        left, mid, right = spec[:, :-2], spec[:, 1:-1], spec[:, 2:]
        curve, slope = left + right - 2 * mid, (right - left) / 2
        shift = np.where(np.abs(slope) < np.abs(curve), -slope / np.where(curve == 0, 1.0, curve), 0.0)
        loud = np.where(spec > 0.1 * spec.max(axis=1, keepdims=True), spec, 0.0)
        inner = self.freqs[1:-1]
        peak = (loud[:, 1:-1] > loud[:, :-2]) & (loud[:, 1:-1] >= loud[:, 2:]) & (inner >= 150.0) & (inner < 4000.0)
        strength = np.where(peak, mid + slope * shift / 2, 0.0)
        best = strength.argmax(axis=1)
        rows = np.arange(len(spec))
        some = peak[rows, best]
        return ((best + 1 + shift[rows, best]) * self.rate / self.n_fft)[some]

    def peak_of(self, piece: np.ndarray, at: int, n: int, chunk: int) -> float:
        return float(self.decibels(self.magnitudes(piece, at, n, chunk)).max())

    def values(self, piece: np.ndarray, at: int, n: int, chunk: int, peak: float | None) -> list[np.ndarray]:
        """Per feature, the values of the chunk's frames.  ``peak``: the signal's largest mel power in decibels, 80 below which
        lies the floor of its cepstra (None: the chunk is the signal)."""
        spec = self.magnitudes(piece, at, n, chunk)
        total = spec.sum(axis=1, keepdims=True)
        share = spec / np.where(total > 0, total, 1.0)
        centroid = share @ self.freqs
        bandwidth = np.sqrt((share * (self.freqs - centroid[:, None]) ** 2).sum(axis=1))
        rolloff = self.freqs[np.argmax(np.cumsum(spec, axis=1) >= 0.85 * total, axis=1)]
        db = self.decibels(spec)
        mfcc = np.maximum(db, (db.max() if peak is None else peak) - 80.0) @ self.dct.T
        edged = self.framed(piece, at, n, chunk, "edge")
        negative = np.where(np.abs(edged) <= 1e-10, 0.0, edged) < 0
        zcr = (negative[:, 1:] != negative[:, :-1]).sum(axis=1) / self.n_fft
        rms = np.sqrt((self.framed(piece, at, n, chunk, "constant") ** 2).mean(axis=1))
        return [*mfcc.T, centroid, bandwidth, rolloff, zcr, rms, self.pitch(spec)]

    def parts(self, piece, at: int, n: int, chunk: int, peak: float | None) -> list[dict] | None:
        """Count, mean, squared deviations, least and largest value per feature; None for samples that are not finite."""
        piece = np.asarray(piece if piece is not None else [], np.float64)
        if n <= 0 or not np.isfinite(piece).all():
            return None
        out = []
        for v in self.values(piece, at, n, chunk, peak):
            mean = float(v.mean()) if len(v) else 0.0
            out.append({"n": len(v), "mean": mean, "m2": float(((v - mean) ** 2).sum()), "lo": float(v.min()) if len(v) else None, "hi": float(v.max()) if len(v) else None})
        return out


def signal_features(df: DataFrame, id_col: str, samples: str, **how) -> DataFrame:
    """79-name feature row per signal (52 MFCC, 16 spectral, 8 time statistics, duration,
    rate, error flag); bad or empty input gives zeros and the error flag.  ``how``: see ``Spectra``.

    A signal of up to ``chunk_frames`` frames is worked on where it lies.  Longer ones are cut into chunks of as many
    frames, with half a frame of samples around them, which are dealt out over all tasks by signal and chunk and stored: one
    pass finds each signal's peak, one the moments of its chunks, which are merged.  A task holds one chunk at a time.
    """
    s = Spectra(**how)
    id_field = next(f for f in df.schema.fields if f.name == id_col)
    names = [n[:-len("_mean")] for n in feature_names(s.n_mfcc)[::len(STATS)]]
    n = F.coalesce(F.size(samples), F.lit(-1))
    chunks = F.ceil((F.floor(F.greatest(n, F.lit(0)) / s.hop) + 1) / s.chunk_frames).cast("int")
    part_type = T.StructField("parts", T.ArrayType(T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("mean", "m2", "lo", "hi")]])))
    size = T.StructField("_n", T.IntegerType())

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "_n": b["_n"], "parts": [s.parts(x, 0, k, 0, None) for x, k in zip(b[samples], b["_n"], strict=True)]})

    short = df.where(chunks <= 1).select(id_col, F.greatest(n, F.lit(0)).alias("_n"), samples).mapInPandas(whole, T.StructType([id_field, size, part_type]))

    def span(c: Column) -> tuple[Column, Column]:
        first, around = c * (s.chunk_frames * s.hop), s.n_fft - s.half + 1
        return F.greatest(first - around, F.lit(0)), F.least(first + (s.chunk_frames - 1) * s.hop + around, n)

    pieces = stored(_pieces(df.where(chunks > 1), id_col, samples, chunks, span), "signal-chunks")

    def peaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for x, at, k, c in zip(b["piece"], b["from"], b["_n"], b["chunk"], strict=True):
                x = np.asarray(x, np.float64)
                found.append(s.peak_of(x, at, k, c) if np.isfinite(x).all() else None)
            yield pd.DataFrame({"_row": b["_row"], "_peak": found})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [s.parts(x, at, k, c, p) for x, at, k, c, p in zip(b["piece"], b["from"], b["_n"], b["chunk"], b["_peak"], strict=True)]
            yield pd.DataFrame({"_row": b["_row"], id_col: b[id_col], "_n": b["_n"], "chunk": b["chunk"], "parts": got})

    peak = stored(pieces.select("_row", "from", "_n", "chunk", "piece").mapInPandas(peaks, "_row long, _peak double").groupBy("_row").agg(F.max("_peak").alias("_peak")), "signal-peaks")
    schema = T.StructType([T.StructField("_row", T.LongType()), id_field, size, T.StructField("chunk", T.IntegerType()), part_type])
    # moments only: small, and written so that the samples are read once
    parts = stored(pieces.join(peak, "_row", "left").mapInPandas(cut, schema), "signal-parts")
    carry = [F.any_value(id_col).alias(id_col), F.max("_n").alias("_n"), F.bool_or(F.col("parts").isNull()).alias("_bad")]
    long = _merged(parts, "_row", carry) if parts.limit(1).count() else None
    bad_only = parts.groupBy("_row").agg(*carry)
    features = short.withColumn("_bad", F.col("parts").isNull())
    if long is not None:
        fields = [id_col, "_n", "parts", "_bad"]
        broken = bad_only.where("_bad").withColumn("parts", F.lit(None).cast(PART)).select(*fields)
        features = features.select(*fields).unionByName(long.where(~F.col("_bad")).select(*fields)).unionByName(broken)
    stats = [c for i, name in enumerate(names) for c in _stats_of(F.get("parts", F.lit(i)), name)]
    return features.select(id_col, *stats, (F.col("_n") / F.lit(float(s.rate))).alias("duration"), F.lit(s.rate).alias("sample_rate"),
                           F.col("_bad").cast("int").alias("audio_processing_error"))
