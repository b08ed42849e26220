"""Text quality from random-indexing word vectors and a small network.

A token is a word's lower-cased letters or its shape (runs of upper, lower, digits and the
other characters as they are, cut to six runs).  Each token's index vector is a sparse
ternary vector drawn from its hash.  Its context vector, learned on the sample, sums the
index vectors of the tokens before and after it.  A document is pooled from the vectors of
all its words, whole; a two-layer network reads the pool, and a temperature fitted on rows that
the network was not trained on calibrates its probabilities.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm import kernels

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of id.
SAMPLE = 2000
DIM = 48
BUCKETS = 1 << 14
NONZERO = 4
HIDDEN = 24
EPOCHS = 60
SEED = 7

# Character classes of a shape: upper a, lower b, digit c, letters beyond ASCII d.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B] = ord("a")
SHAPE[0x61:0x7B] = ord("b")
SHAPE[0x30:0x3A] = ord("c")
SHAPE[0x80:] = ord("d")


def _index_places() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the parts of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _index_vectors() -> np.ndarray:
    place, sign = _index_places()
    flat = (np.arange(BUCKETS)[:, None] * DIM + place).ravel()
    out = np.bincount(flat, sign.ravel(), BUCKETS * DIM).reshape(BUCKETS, DIM)
    return (out / np.sqrt(NONZERO)).astype(np.float32)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape, one letter per run of a class."""
    kind = SHAPE[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    inside = np.zeros(len(data) + 1, np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    change[starts] = True
    kept = np.flatnonzero(change & (np.cumsum(inside[:-1]) > 0))
    first = np.searchsorted(kept, starts)
    last = np.minimum(np.searchsorted(kept, ends), first + 6)
    return kernels.span_hashes(np.ascontiguousarray(kind[kept]), first, last)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and of its shape, and the first word of each row."""
    starts, ends, first = kernels.words(data, offsets)
    low = kernels.LOWER[data]
    word = (kernels.span_hashes(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    shape = (_shapes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return word, shape, first


def pooled(data: np.ndarray, offsets: np.ndarray, context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row per document: mean context vector of its shapes and of its words, how
    often the next word and the one after it have the same vector, the length of the mean index
    vectors (1 if all are one word), and the text's length.  An empty text pools to zeros."""
    word, shape, first = tokens(data, offsets)
    out = np.zeros((len(offsets) - 1, 2 * DIM + 6), np.float32)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        n = b - a
        if not n:
            continue
        at, count = np.unique(word[a:b], return_counts=True)
        st, counts = np.unique(shape[a:b], return_counts=True)
        share, shares = count / n, counts / n
        out[d, :DIM] = shares @ context[st]
        out[d, DIM : 2 * DIM] = share @ context[at]
        for j, lag in enumerate((1, 2)):
            if n > lag:
                out[d, 2 * DIM + j] = np.count_nonzero(word[a + lag : b] == word[a : b - lag]) / (n - lag)
        out[d, 2 * DIM + 2] = np.linalg.norm(share @ index[at])
        out[d, 2 * DIM + 3] = np.linalg.norm(shares @ index[st])
        out[d, 2 * DIM + 4] = np.log1p(n) / 10
        out[d, 2 * DIM + 5] = len(at) / n
    return out


@dataclass
class Model:
    context: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pool: np.ndarray) -> np.ndarray:
        x = np.clip((pool - self.shift) * self.scale, -8, 8)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, pool: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(pool).astype(np.float64) / self.temperature))


def fit(texts: list[str | None], labels: np.ndarray) -> Model:
    """Fit on texts with labels 0 or 1.  Without rows of both labels every score is the label
    that there is, or 0.5 without any."""
    data, offsets = kernels.buffers(pa.array(texts, pa.large_string()))
    index = _index_vectors()
    word, shape, first = tokens(data, offsets)
    context = np.zeros(BUCKETS * DIM)
    place, sign = _index_places()
    inner = np.ones(len(word), bool)
    inner[first[:-1][first[:-1] < len(word)]] = False
    pair = np.flatnonzero(inner)
    for own in (word, shape):
        for other in (word, shape):
            for at, near in ((own[pair], other[pair - 1]), (own[pair - 1], other[pair])):
                for j in range(NONZERO):
                    context += np.bincount(at * DIM + place[near, j], sign[near, j], len(context))
    context = context.reshape(BUCKETS, DIM).astype(np.float32)
    # A token the sample does not hold keeps its index vector.
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.where(norm > 0, context / np.maximum(norm, 1e-9), index)
    pool = pooled(data, offsets, context, index)
    y = np.asarray(labels, np.float32)
    shift, scale = (pool.mean(0), 1 / np.maximum(pool.std(0), 1e-3)) if len(y) else (0.0, 1.0)
    rng = np.random.default_rng(SEED)
    width = 2 * DIM + 6
    w1 = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)).astype(np.float32)
    p = [w1, np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32)]
    model = Model(context, shift, scale, *p[:3], 0.0, 1.0)
    if len(np.unique(y)) < 2:
        model.b2 = 0.0 if not len(y) else (8.0 if y[0] > 0.5 else -8.0)
        return model
    # Every fourth row is kept from training, for the temperature.
    held = np.arange(len(y)) % 4 == 3
    x = np.clip((pool - shift) * scale, -8, 8).astype(np.float32)
    rows = np.flatnonzero(~held)
    weight = np.where(y > 0.5, 0.5 / max(y[rows].mean(), 1e-3), 0.5 / max(1 - y[rows].mean(), 1e-3)) ** 0.5
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for i in range(0, len(rows), 64):
            r = rows[i : i + 64]
            h = np.tanh(x[r] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[r]) * weight[r] / len(r)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [x[r].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            step += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(context, shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        z, t = model.logits(pool[held]), y[held]
        grid = np.geomspace(0.25, 8, 41)
        losses = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id falls in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3, F.lit(0))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit on the rows of one task; the model leaves as a file of its arrays."""
    texts, labels = [], []
    for b in batches:
        texts += b.column("text").to_pylist()
        labels += b.column("y").to_pylist()
    out = io.BytesIO()
    np.savez(out, **vars(fit(texts, np.array(labels, np.float32))))
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside fold 1, those with the smallest hash of
    id.  The sample is fitted in one task, so the driver holds the model only.  Labels other than 0 and 1 and null labels are left out; a label that repeats for an
    id counts once, the smaller one."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
        .filter((fold("id") != 1) & F.col("y").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    # Rows that repeat an id may exceed the sample, so it bounds them again.
    rows = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample).select("text", "y")
    made = rows.mapInArrow(_fitted, "model binary").first()
    if made is None:
        return fit([], np.zeros(0, np.float32))
    with np.load(io.BytesIO(made["model"])) as arrays:
        return Model(**{name: arrays[name] for name in arrays.files})


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and the label it predicts, under two ``names``; columns of
    these names are replaced.  Null and empty texts are scored from an all-zero pool.  Texts are
    read whole."""
    out = docs.drop(*names)
    # Plain arrays, as a worker that lacks this package cannot read one of its classes.
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, index = Model(**shared.value), _index_vectors()
        for whole in batches:
            for batch in kernels.slices(whole, "text"):
                pool = pooled(*kernels.buffers(batch.column("text")), m.context, index)
                s = m.scores(pool)
                columns = [batch.column(c) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=[*batch.schema.names, *names],
                )

    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return out.mapInArrow(scores, T.StructType([*out.schema.fields, *added]))
