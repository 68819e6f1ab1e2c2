"""Quality by naive Bayes support vectors (operator 8).

A document is the set of its n-grams: words and pairs of words, and the same of word shapes (runs of
lower case, upper case, digits and each punctuation mark; a word equal to the one before it has the
shape of a repeat). The indicators are scaled by the log-count ratio of the classes, scaled to unit
length, and a linear model with hinge loss is fitted to them by dual coordinate descent; a logistic
curve over its margins gives the score.

The fit uses at most ``TRAIN_ROWS`` labelled documents (chosen by a hash of the id) in one task; the
scores cover every row.

Defined results: a text without words has the bias as its only feature; labels may be missing,
repeated (the largest counts) or null (ignored); with labels of one class only, or none, every score
is that class's share, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, fold, labelled_sample, mix64, span_hashes, table, text_blocks, texts_of, word_spans

#: Labelled documents of the fit, at most.
TRAIN_ROWS = 8000
BUCKETS = 1 << 18
LEAST_DOCUMENTS = 5
COST = 1.0
PASSES = 12
FOLDS, HELD_FOLD = 3, 1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_REPEAT = np.uint64(0x5EED)


def indicators(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of each text of a block, once, sorted by row."""
    starts, ends, rows = word_spans(raw, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = span_hashes(ascii_lower(raw), starts, ends)
    shape = _SHAPE[raw]
    kept = np.ones(len(raw), dtype=bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = span_hashes(shape[kept], place[starts], place[ends])
    follows = np.zeros(len(words), dtype=bool)
    follows[1:] = rows[1:] == rows[:-1]
    again = follows.copy()
    again[1:] &= words[1:] == words[:-1]
    shapes = np.where(again, _REPEAT, shapes)

    def pairs(x, salt):
        return mix64(x[:-1] * np.uint64(3) + x[1:] + np.uint64(salt))[follows[1:]]

    later = rows[1:][follows[1:]]
    grams = np.concatenate([mix64(words + np.uint64(1)), pairs(words, 2), mix64(shapes + np.uint64(3)), pairs(shapes, 4)])
    key = (np.concatenate([rows, later, rows, later]) * BUCKETS) + (grams % np.uint64(BUCKETS)).astype(np.int64)
    key = np.unique(key)
    return key // BUCKETS, key % BUCKETS


def fit(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float, float, float]:
    """(weights by bucket with the ratio inside, ratio's place of the bias, slope, offset of the curve)."""
    n = len(y)
    positive = y == 1
    if n == 0 or positive.all() or not positive.any():
        share = 0.5 if n == 0 else float(positive.mean())
        return np.zeros((2, BUCKETS), dtype=np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    count = np.bincount(bucket, minlength=BUCKETS)
    p = np.bincount(bucket[positive[row]], minlength=BUCKETS) + 1.0
    q = np.bincount(bucket[~positive[row]], minlength=BUCKETS) + 1.0
    ratio = np.where(count >= LEAST_DOCUMENTS, np.log(p / (positive.sum() + 2)) - np.log(q / ((~positive).sum() + 2)), 0.0)
    use = ratio[bucket] != 0
    row, bucket = row[use], bucket[use]
    norm = np.sqrt(np.bincount(row, weights=ratio[bucket] ** 2, minlength=n) + 1.0)  # 1: the bias
    value = ratio[bucket] / norm[row]
    bounds = np.searchsorted(row, np.arange(n + 1))
    sign, w, bias = np.where(positive, 1.0, -1.0), np.zeros(BUCKETS), 0.0
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(n).tolist():
            lo, hi = bounds[i], bounds[i + 1]
            f, x, b = bucket[lo:hi], value[lo:hi], 1.0 / norm[i]
            slope = sign[i] * (w[f] @ x + bias * b) - 1.0
            new = min(max(alpha[i] - slope, 0.0), COST)  # the rows have length 1
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * x
                bias += step * b
                alpha[i] = new
    margin = np.bincount(row, weights=w[bucket] * value, minlength=n) + bias / norm
    a, c = _curve(margin, positive)
    return np.stack([w * ratio, ratio**2]).astype(np.float32), bias, a, c


def _curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton's method with a small ridge."""
    t = np.where(positive, (positive.sum() + 1.0) / (positive.sum() + 2.0), 1.0 / ((~positive).sum() + 2.0))
    x = np.stack([margin, np.ones_like(margin)])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(beta @ x, -30, 30)))
        grad = x @ (p - t) + 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), grad)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(sample: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Fits on (text, y), a bounded sample, in one task."""

    def run(batches):
        row, bucket, y = [], [], []
        for batch in batches:
            label = batch.column("y").to_numpy()
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                r, b = indicators(raw, offs)
                row.append(r + len(y))
                bucket.append(b)
                y += label[lo:hi].tolist()
        if not y:
            return
        w, bias, a, c = fit(np.concatenate(row), np.concatenate(bucket), np.array(y))
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "bias": [float(bias)], "a": [a], "c": [c]})

    found = sample.repartition(1).mapInArrow(run, "weights binary, bias double, a double, c double").collect()
    if not found:
        return np.zeros((2, BUCKETS), dtype=np.float32), 0.0, 0.0, 0.0
    return np.frombuffer(found[0].weights, dtype=np.float32).reshape(2, BUCKETS), found[0].bias, found[0].a, found[0].c


def scores(texts: DataFrame, model: tuple[np.ndarray, float, float, float]) -> DataFrame:
    """(doc_id, score) of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            (w, square), bias, a, c = shared.value
            score = np.zeros(batch.num_rows)
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                row, bucket = indicators(raw, offs)
                total = np.bincount(row, weights=w[bucket], minlength=hi - lo) + bias
                norm = np.sqrt(np.bincount(row, weights=square[bucket], minlength=hi - lo) + 1.0)
                score[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(a * total / norm + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(labelled_sample(docs, labels, "quality", FOLDS, HELD_FOLD, TRAIN_ROWS))
    held = (fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out")
    return scores(texts_of(docs), model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
