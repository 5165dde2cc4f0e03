"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal, scored as sparse dot products."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import _CODE, SMALL_STEP, mix, powers, row_blocks, texts_of, utf8, window_hash

#: Rows that a model is fitted on at most (a documented bound; the rows of smallest hash are taken).
FIT_ROWS = 12_000
#: Passes over the sample, the same at every size.
EPOCHS = 10
BITS = 18
#: Rows of a batch that are filtered at once.
SLICE_ROWS = 1000
_KIND = np.full(256, 2, np.uint8)  # punctuation
_KIND[[32, 9, 10, 11, 12, 13]] = 0
for _low, _high, _kind in ((97, 122, 1), (65, 90, 1), (48, 57, 1), (128, 255, 1)):
    _KIND[_low : _high + 1] = _kind
_SHAPE = np.arange(256, dtype=np.uint64)
for _low, _high, _as in ((97, 122, 97), (65, 90, 65), (48, 57, 48), (128, 255, 97)):
    _SHAPE[_low : _high + 1] = _as
_SHAPE = mix(_SHAPE + np.uint64(1000))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _tokens(block: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words (runs of letters and digits, or of other marks), their hashes, and hashes of their shape."""
    n = len(block)
    kind = _KIND[block]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[breaks[breaks < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[block] * up[:n], out=prefix[1:])
    h = mix((prefix[ends] - prefix[starts]) * down[starts])
    # A shape keeps the kinds of the first two bytes, the last byte, and the length up to eight.
    second = np.minimum(starts + 1, ends - 1)
    shape = mix(_SHAPE[block[starts]] + _SHAPE[block[second]] * np.uint64(3) + _SHAPE[block[ends - 1]] * np.uint64(5) + np.minimum(ends - starts, 8).astype(np.uint64))
    return starts, h, shape


def sparse_rows(batch: pa.RecordBatch, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each row: word 1- and 2-grams, and 1- to 3-grams of word shapes, hashed.

    A value is log(1 + count), and a row is scaled to length 1 for each kind of n-gram's share. A row without words is empty.
    """
    data, offsets = utf8(batch["text"])
    room = np.uint64((1 << bits) - 1)
    for i, j in row_blocks(offsets, SMALL_STEP):
        base = offsets[i]
        starts, h, shape = _tokens(data[base : offsets[j]], offsets[i:j] - base)
        by_row = np.searchsorted(starts, offsets[i : j + 1] - base)
        grams = [h, window_hash(h, 2), shape + np.uint64(7), window_hash(shape, 2) + np.uint64(9), window_hash(shape, 3)]
        grams = [(mix(g) & room).astype(np.int64) for g in grams]
        for r in range(j - i):
            a, b = by_row[r], by_row[r + 1]
            own = np.concatenate([g[a : max(a, min(len(g), b - w))] for g, w in zip(grams, (0, 1, 0, 1, 2), strict=True)])
            at, count = np.unique(own, return_counts=True)
            value = np.log1p(count)
            norm = np.sqrt((value * value).sum())
            yield at.astype(np.int32), (value / norm if norm else value).astype(np.float32)


def ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model:
    """Follow-the-regularised-leader with per-coordinate rates, one row at a time in the given order, ``epochs`` times over.

    ``rows`` is iterated over once for each epoch; a row is widened where it is learnt from, so that no wide copy of all is held.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    last, one = np.array([size - 1]), np.ones(1)  # the bias

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for (at, v), y in zip(rows, labels, strict=True):
            at, v = np.concatenate((at, last)), np.concatenate((v, one))
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


class SparseRows:
    """Feature numbers and values of many rows, read in place from the buffers of Arrow batches in a given order."""

    def __init__(self, batches: list[pa.RecordBatch], order: np.ndarray):
        firsts = np.concatenate(([0], np.cumsum([b.num_rows for b in batches], dtype=np.int64)))
        part = np.searchsorted(firsts, order, "right") - 1
        self.places = list(zip(part.tolist(), (order - firsts[part]).tolist(), strict=True))
        self.parts = [(_entries(b["at"], np.int32), _entries(b["value"], np.float32)) for b in batches]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p, i in self.places:
            (at, a), (value, v) = self.parts[p]
            yield at[a[i] : a[i + 1]], value[v[i] : v[i + 1]]


def _entries(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes, and their offsets by row."""
    data, offsets = utf8(column)
    size = np.dtype(kind).itemsize
    return data[: len(data) // size * size].view(kind), offsets // size


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS) -> Model:
    """A model of ``label_col`` fitted on at most ``fit_rows`` labelled rows that are not held out.

    Features are taken in parallel; the bounded sample alone is trained on in one task, which returns the weights (2^bits
    numbers). Rows with a null id or label, and ids with more than one label, are not learnt from; of rows that repeat an
    id one is. Without labelled rows the model gives 0.5.
    """
    marks = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y"))
    marks = marks.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    sample = marks.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]) if fit_rows <= 100_000 else texts_of(docs, id_col, text_col).join(sample, "doc_id").dropDuplicates(["doc_id"])

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sparse_rows(batch, bits))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "y", "at", "value"])

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        ids, labels = ([x for b in got for x in b[c].to_pylist()] for c in ("doc_id", "y"))
        order = sorted(range(len(ids)), key=lambda r: (zlib.crc32(str(ids[r]).encode()), ids[r]))
        model = ftrl(SparseRows(got, np.array(order, np.int64)), np.array([labels[r] for r in order]), bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    one = rows.mapInArrow(features, "doc_id long, y double, at binary, value binary").repartition(1).mapInArrow(train, "weights binary, bias double").first()
    if one is None:
        return Model(np.zeros(1 << bits, np.float32), 0.0)
    return Model(np.frombuffer(one["weights"], np.float32), one["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= threshold).

    Only the text is scored. Null and empty texts have no features and get the score of the bias. A null id counts as not
    held out. Equal texts get equal scores; a score at the threshold is accepted. A very long text is read whole, by itself.
    An empty table gives an empty result. Other columns are not read, so their names can't clash. The broadcast model has
    2^bits numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(float(weights[at] @ v) + bias, -35, 35))) for at, v in sparse_rows(batch, bits)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns, where they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for p in range(0, max(1, whole.num_rows), SLICE_ROWS):  # parts, as what stays is a copy
                batch = whole.slice(p, SLICE_ROWS)
                rows = sparse_rows(pa.RecordBatch.from_arrays([batch.column(place)], ["text"]), bits)
                good = [1 / (1 + np.exp(-np.clip(float(weights[at] @ v) + bias, -35, 35))) >= threshold for at, v in rows]
                yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
