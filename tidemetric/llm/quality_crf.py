"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad; its features describe its own bytes and words and those of
the lines before and after it. Forward-backward gives each line's probability to be good,
and the mean of these, weighted by line length, is the document's quality.

The field is fitted by gradient ascent on a bounded sample of labelled documents whose
lines carry the document's label. Features are computed in Spark tasks on whole Arrow
batches; the driver sees only the sample's feature rows, and broadcasts the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemetric.llm.common import is_held_out, small_batches, stored, table
from tidemetric.llm.words import ngrams, text_buffers, words_of

#: Bounds of the training sample: documents (about, picked by a hash of the id), lines of one
#: document, and lines of all, which bounds what the driver holds (180 bytes a line).
TRAIN_DOCS = 4000
TRAIN_LINES = 1000
TRAIN_ALL_LINES = 200_000
STEPS = 150
RATE = 0.1
RIDGE = 1e-4
THRESHOLD = 0.3

NEIGHBOUR = 14
OWN = 16
WIDTH = OWN + 2 * NEIGHBOUR + 1
#: Lines whose features, neighbours' included, are held at a time.
BLOCK = 1 << 16

_UPPER, _LOWER, _DIGIT, _SENTENCE, _SYMBOL, _SPACE, _HIGH = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[:0x21] = _SPACE
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[48:58] = _DIGIT
_CLASS[list(b".,;:?'\"()-")] = _SENTENCE
_CLASS[0x80:] = _HIGH


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every line; a row without text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.append(start[1:], 0) - 1
    end[last] = offsets[row[last] + 1]
    return row, start, end


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, own features) of every line of the rows in ``data``; counts are held for one kind of byte at a time."""
    row, start, end = line_bounds(data, offsets)
    lines = len(row)
    kinds = _CLASS[data]
    size = (end - start).astype(float)
    wrow, ws, we, wh = words_of(data, offsets)
    wline = np.searchsorted(start, ws, "right") - 1
    counts, in_word = [], np.zeros(len(ws), np.int32)
    total = np.zeros(len(data) + 1, np.int32)
    for kind in range(_HIGH + 1):
        np.cumsum(kinds == kind, out=total[1:])
        counts.append((total[end] - total[start]).astype(float))
        if kind in (_UPPER, _LOWER, _HIGH):
            in_word += total[we] - total[ws]
    upper, lower, digit, sentence, symbol, _, high = counts

    def per_line(mask) -> np.ndarray:
        return np.bincount(wline[mask], minlength=lines).astype(float)

    words = np.bincount(wline, minlength=lines).astype(float)
    bare = in_word == 0
    marked = kinds[we - 1] == _SYMBOL if len(we) else np.zeros(0, bool)
    again = np.zeros(len(wh), bool)
    again[1:] = (wh[1:] == wh[:-1]) & (wline[1:] == wline[:-1])
    same_line = _seen_before(wh ^ (wline.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at, gram = ngrams(wrow, wh, 3)
    echoed = _seen_before(gram ^ (wrow[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    letters = upper + lower + high
    solid = np.maximum(letters + digit + sentence + symbol, 1)
    each = np.maximum(words, 1)
    closes = np.zeros(lines)
    full = np.flatnonzero(end > start)
    closes[full] = kinds[end[full] - 1] == _SENTENCE
    own = np.column_stack([
        np.log1p(size), np.log1p(words), np.minimum(solid / each, 40) / 10, letters / solid,
        upper / np.maximum(upper + lower, 1), digit / solid, sentence / solid, symbol / solid,
        per_line(bare) / each, per_line(marked) / each, per_line(again) / each, per_line(same_line) / each,
        np.bincount(wline[at][echoed], minlength=lines) / each, closes,
        np.append(True, row[1:] != row[:-1])[:lines], size == 0,
    ])
    return row, size + 1, own


def with_neighbours(row: np.ndarray, own: np.ndarray, low: int, high: int) -> np.ndarray:
    """All features of the lines ``low`` to ``high``: their own, those of the lines before and after, and 1."""
    n = high - low
    out = np.zeros((n, WIDTH))
    out[:, :OWN], out[:, -1] = own[low:high], 1.0
    at = np.arange(max(low, 1), high)
    out[at - low, OWN : OWN + NEIGHBOUR] = own[at - 1, :NEIGHBOUR] * (row[at - 1] == row[at])[:, None]
    at = np.arange(low, min(high, len(row) - 1))
    out[at - low, OWN + NEIGHBOUR : -1] = own[at + 1, :NEIGHBOUR] * (row[at + 1] == row[at])[:, None]
    return out


@dataclass
class ChainField:
    """Weights of the good-minus-bad score of a line, and of the pairs (line, next line)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def unary(self, row: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for low in range(0, len(row), BLOCK):
            high = min(low + BLOCK, len(row))
            out[low:high] = np.clip((with_neighbours(row, own, low, high) - self.mean) / self.scale, -5, 5) @ self.weights
        return out


def forward_backward(unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and expected counts of neighbouring labels.

    Chains are the runs ``starts, lengths`` of ``unary``; all chains move a step at a time,
    longest first, so the loop is over line numbers and not over documents.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains longer than t
    u = np.clip(unary, -30, 30)
    own = np.column_stack([1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))])
    move = np.exp(pairs - pairs.max())
    alpha, beta = np.empty_like(own), np.ones_like(own)
    for t in range(longest):
        i = starts[: active[t]] + t
        a = own[i] if t == 0 else own[i] * (alpha[i - 1] @ move)
        alpha[i] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        i = starts[: active[t + 1]] + t
        back = own[i + 1] * beta[i + 1]
        joint = alpha[i][:, :, None] * move * back[:, None, :]
        expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = back @ move.T
        beta[i] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), expected


def fit_field(features: np.ndarray, good: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int = STEPS) -> ChainField:
    """Gradient ascent (Adam) on the log-likelihood of the lines' labels, with a ridge."""
    mean, scale = features.mean(0), features.std(0)
    mean[-1], scale[scale < 1e-6] = 0.0, 1.0
    field = ChainField(mean, scale, np.zeros(features.shape[1]), np.zeros((2, 2)))
    x = np.clip((features - mean) / scale, -5, 5)
    counts = np.zeros((2, 2))
    inside = np.ones(len(good), bool)
    inside[starts] = False
    now = np.flatnonzero(inside)
    np.add.at(counts, (good[now - 1], good[now]), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected = forward_backward(x @ field.weights, starts, lengths, field.pairs)
        grad = np.concatenate([x.T @ (good - p), (counts - expected).ravel()]) / len(good) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("quality").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for first, data, offsets in text_buffers(batch.column("text"), 1 << 19):
            row, _, own = line_features(data, offsets)
            lengths = np.bincount(row, minlength=len(offsets) - 1)
            for r, end in enumerate(np.cumsum(lengths)):
                if lengths[r] <= TRAIN_LINES:
                    rows = with_neighbours(row, own, end - lengths[r], end).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[first + r])]), pa.array([int(marks[first + r])], pa.int32()), pa.array([int(lengths[r])]), pa.array([rows.tobytes()])], ["doc_id", "quality", "lines", "features"])


def train_field(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ChainField | None:
    """Fit on (doc_id, text) ⋈ (doc_id, quality); None where no label is known.

    Rows with a null id, text or label teach nothing; of rows that repeat an id one text
    does. Only ``quality`` is read of the labels. Documents come in order of a hash of
    their id until the sample holds ``TRAIN_ALL_LINES`` lines, so reruns agree.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    total = known.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64(F.lit("crf"), "doc_id"), F.lit(1 << 40))
    picked = known.filter(place < int(min(1.0, train_docs / total) * (1 << 40)))
    joined = docs.filter("text is not null").select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = stored(joined.mapInArrow(_sampled, "doc_id long, quality int, lines long, features binary"), "sample").withColumn("place", place)
    sizes = sample.select("place", "lines").toArrow().to_pandas().sort_values("place")  # a row for each of about ``train_docs`` documents
    taken = sizes["place"][sizes["lines"].cumsum() <= TRAIN_ALL_LINES]
    if not len(taken):
        return None
    rows = sample.filter(F.col("place") <= int(taken.iloc[-1])).toArrow().to_pandas().sort_values("place")
    parts = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["features"]]
    lengths = np.array([len(p) for p in parts])
    return fit_field(np.vstack(parts).astype(float), np.repeat(rows["quality"].to_numpy(), lengths), np.cumsum(lengths) - lengths, lengths)


def batch_scores(column: pa.Array, field: ChainField | None) -> np.ndarray:
    """Quality of each text of an Arrow column."""
    out = np.ones(len(column))
    if field is None:
        return out
    for first, data, offsets in text_buffers(column, 1 << 19):
        row, length, own = line_features(data, offsets)
        lines = np.bincount(row, minlength=len(offsets) - 1)
        good, _ = forward_backward(field.unary(row, own), np.cumsum(lines) - lines, lines, field.pairs)
        out[first : first + len(lines)] = np.bincount(row, good * length) / np.bincount(row, length)
    return np.clip(out, 0.0, 1.0)


def score_quality(docs: DataFrame, field: ChainField | None) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1; replaces a column of that name).

    Whole texts are scored; a null or empty text is one empty line. Without a field (no
    label known) every row scores 1.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    base = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(batch_scores(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train_field(docs.filter(~is_held_out()), table(spark, sf_dir, "labels").filter(~is_held_out()))
    scored = score_quality(docs, field)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier does not reject."""
    field = train_field(docs.filter(~is_held_out()), table(spark, sf_dir, "labels").filter(~is_held_out()))
    return score_quality(docs, field).filter(F.col("score") >= THRESHOLD).select(docs.columns)
