"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded: shares of byte values,
of byte classes that follow one another, and how far it compresses, through a learned layer. Gated
attention gives each passage a weight, learned from the documents' labels alone, and the weighted sum of
the encodings gives the score. All passages of every text are encoded; only fitting is on a sample.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the least hash of their doc_id;
that bound is a parameter. Fitting, like scoring, uses every passage of them; their features, in half precision, are what
the driver gets.

Defined cases: a null or empty text is one empty passage; a very long text is taken whole, all its passages; labels that
are null are left out, and a doc_id with several labels has their mean; without labels of both kinds every score is the mean
label, or 1/2 without any; rows with the same doc_id are separate documents, and of those with a label the least text is
learned from; a null doc_id has no label; an empty table gives an empty result; further columns are kept, but for those of
the names that are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, utf8

PASSAGE, SAMPLE = 1024, 8000
#: Width of the encoding and of the attention.
WIDTH, HEADS = 32, 16

# Byte classes: control and space, line break, digit, lower, upper, lead byte, other bytes beyond ASCII, end of
# sentence, other marks.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[:33] = 0
_CLASS[10] = 1
_CLASS[48:58] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[192:] = 5
_CLASS[128:192] = 6
_CLASS[[33, 44, 46, 59, 63]] = 7
_N = 9
FEATURES = 128 + _N * _N + 4


def passages(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of texts, and how many passages each has."""
    counts = np.maximum(-(-(ends - starts) // PASSAGE), 1)
    begin = np.repeat(starts, counts) + ranges(np.zeros(len(counts), np.int64), counts) * PASSAGE
    stop = np.minimum(begin + PASSAGE, np.repeat(ends, counts))
    size = stop - begin
    n = len(begin)
    spots = ranges(begin, size)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    bytes_ = data[spots]
    values = np.bincount(owner * 128 + np.minimum(bytes_, 127), minlength=n * 128).reshape(n, 128)
    classes = _CLASS[bytes_].astype(np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    follow = np.bincount(owner[inner] * (_N * _N) + classes[inner] * _N + classes[inner + 1], minlength=n * _N * _N).reshape(n, _N * _N)
    whole = np.maximum(size, 1)[:, None]
    packed = np.array([len(zlib.compress(data[a:b].tobytes(), 1)) for a, b in zip(begin.tolist(), stop.tolist())], float)
    # How often a byte equals the one before it, and the one a few words before, tell of runs.
    same = np.bincount(owner[inner], weights=bytes_[inner] == bytes_[inner + 1], minlength=n)
    extra = np.stack([np.log1p(size) / 7, packed / (size + 20), same / whole[:, 0], (size < PASSAGE / 4).astype(float)], 1)
    return np.concatenate([np.sqrt(values / whole), np.sqrt(follow / whole), extra], 1).astype(np.float32), counts


@dataclass
class Model:
    """Parameters: w, b of the encoding, v and u of the attention and its gate, a of the weights, c, d of the score."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags, with what the gradient needs. ``x``: features of all passages, ``counts``: passages of each bag."""
        p, o = self.p, {}
        o["x"] = (x - self.mean) / self.scale
        o["h"] = np.tanh(o["x"] @ p["w"] + p["b"])
        o["t"], o["g"] = np.tanh(o["h"] @ p["v"]), _sigmoid(o["h"] @ p["u"])
        e = (o["t"] * o["g"]) @ p["a"]
        at = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        o["weight"] = e / np.repeat(np.add.reduceat(e, at), counts)
        o["z"] = np.add.reduceat(o["weight"][:, None] * o["h"], at, axis=0)
        o["score"] = _sigmoid(o["z"] @ p["c"] + p["d"])
        return o

    def gradient(self, o: dict[str, np.ndarray], counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        ds = (o["score"] - y) / n
        dz = np.repeat(ds, counts)[:, None] * p["c"]
        inner = (dz * o["h"]).sum(1)
        at = np.cumsum(counts) - counts
        de = o["weight"] * (inner - np.repeat(np.add.reduceat(o["weight"] * inner, at), counts))
        dq = de[:, None] * p["a"]
        dt, dg = dq * o["g"] * (1 - o["t"] ** 2), dq * o["t"] * o["g"] * (1 - o["g"])
        dh = (o["weight"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - o["h"] ** 2)
        return {
            "w": o["x"].T @ dh, "b": dh.sum(0), "v": o["h"].T @ dt, "u": o["h"].T @ dg,
            "a": (o["t"] * o["g"]).T @ de, "c": o["z"].T @ ds, "d": np.array(ds.sum()),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the cross-entropy of the documents' labels."""
    rnd = np.random.default_rng(seed)
    init = lambda *s: rnd.normal(0, 1 / np.sqrt(s[0]), s)
    rest = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = {"w": init(x.shape[1], WIDTH), "b": np.zeros(WIDTH), "v": init(WIDTH, HEADS), "u": init(WIDTH, HEADS), "a": init(HEADS), "c": init(WIDTH) * 0.1, "d": np.array(np.log(rest / (1 - rest)))}
    model = Model(x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-2, p)
    first = np.cumsum(counts) - counts
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for at in range(0, len(y), batch):
            own, step = order[at : at + batch], step + 1
            rows = ranges(first[own], counts[own])
            o = model.forward(x[rows].astype(np.float64), counts[own])
            for k, g in model.gradient(o, counts[own], y[own]).items():
                g = g + decay * p[k] * (k not in "bd")
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | float:
    """A model of ``label`` from rows that aren't held out; the mean label where there is only one kind."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.avg(label).alias("y"))
    marks = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = marks.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: small enough to send to every task.
    known = {r["doc_id"]: r["y"] for r in chosen.collect()}
    if not known:
        return 0.5
    if len({y >= 0.5 for y in known.values()}) < 2:
        return float(np.mean(list(known.values())))
    sent = docs.sparkSession.createDataFrame(list(known.items()), "doc_id long, y double")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sent), "doc_id")
    # Of rows that share a doc_id the least text, so that reruns fit the same model.
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x, counts = passages(*utf8(batch.column("text")))
            ends = np.cumsum(counts).tolist()
            values = [x[a:b].astype(np.float16).tobytes() for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(values, pa.binary())], names=["doc_id", "y", "x"])

    bags = sorted(rows.mapInArrow(run, "doc_id long, y double, x binary").collect(), key=lambda r: r["doc_id"])
    x = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in bags]
    return fit(np.concatenate(x), np.array([len(b) for b in x]), np.array([float(r["y"] >= 0.5) for r in bags]))


def scored(docs: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """Adds score, predicted, passages (their number) and attention (their weights)."""
    added = ("score", "predicted", "passages", "attention")
    kept = [c for c in docs.columns if c not in added]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double, predicted int, passages int, attention array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", 1 << 20):
            x, counts = passages(*utf8(batch.column("text")))
            if isinstance(m, Model):
                o = m.forward(x, counts)
                score, weight = o["score"], o["weight"]
            else:
                score, weight = np.full(len(counts), float(m)), np.repeat(1 / counts, counts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(counts, pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.float32)))],
                names=[*kept, *added],
            )

    return docs.select(*kept).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, score, predicted, passages and attention."""
    out = scored(docs, learned(docs, labels, label, sample), threshold)
    return out.withColumn("held_out", held_out(F.col("doc_id")))
