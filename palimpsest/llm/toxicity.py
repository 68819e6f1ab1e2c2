"""Toxicity by multiple-instance learning (operator 7).

A document is a bag of sentences and only bags have labels. A sentence's probability is a logistic
model over hashed words; a document's is the noisy-or of its sentences, one minus the product of
their complements. The model is trained on document labels through the noisy-or, so the blame for a
label flows to the sentences that explain it, and afterwards :func:`sentences` locates them.

The fit uses at most ``TRAIN_ROWS`` labelled documents (chosen by a hash of the id) in one task, full
batch AdaGrad; the scores cover every row.

Defined results: a null or blank text has no sentence and scores 0; a text of any length is scored
whole; labels may be missing, repeated (the largest counts) or null (ignored); without any label of
one class the scores are those of the start weights, near 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LETTER_BYTES, ascii_lower, fold, labelled_sample, span_hashes, table, text_blocks, texts_of, word_spans

#: Labelled documents of the fit, at most.
TRAIN_ROWS = 8000
BUCKETS = 1 << 21
#: Documents that a word must be in to have a weight.
LEAST_DOCUMENTS = 10
ROUNDS = 300
RATE = 1.0
L2 = 0.02
START_BIAS = -7.0
FOLDS, HELD_FOLD = 5, 0

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True


def instances(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: each sentence's start, end and row, and each word's bucket and sentence.

    A sentence is a run without sentence ends; a run without a word still counts, with no words.
    """
    starts, ends, rows = word_spans(raw, offs, ~_ENDS)
    first, last, _ = word_spans(raw, offs, LETTER_BYTES)
    bucket = (span_hashes(ascii_lower(raw), first, last) % np.uint64(BUCKETS)).astype(np.int64)
    return starts, ends, rows, bucket, np.searchsorted(starts, first, side="right") - 1


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(buckets: np.ndarray, sentence: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias. ``bag`` is each sentence's document, ``y`` each document's label."""
    seen = np.unique(bag[sentence] * BUCKETS + buckets) % BUCKETS
    often = np.bincount(seen, minlength=BUCKETS) >= LEAST_DOCUMENTS
    known = np.flatnonzero(often)
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    use = often[buckets]
    feature, sentence = place[buckets[use]], sentence[use]
    w, bias = np.zeros(len(known)), START_BIAS
    past, past_bias = np.full(len(known), 1e-8), 1e-8
    n = max(1, len(y))
    for _ in range(ROUNDS):
        z = bias + np.bincount(sentence, weights=w[feature], minlength=len(bag))
        total = np.bincount(bag, weights=_softplus(z), minlength=len(y))
        outer = np.where(y == 1, -1.0 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-6), 1.0)
        dz = outer[bag] / (1.0 + np.exp(-np.clip(z, -500, 500))) / n
        grad = np.bincount(feature, weights=dz[sentence], minlength=len(known)) + L2 * w / n
        slope = dz.sum()
        past += grad * grad
        past_bias += slope * slope
        w -= RATE * grad / np.sqrt(past)
        bias -= RATE * slope / np.sqrt(past_bias)
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[known] = w
    return out, bias


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on (text, y), a bounded sample, in one task."""

    def run(batches):
        buckets, sentence, bag, y = [], [], [], []
        n_sentences = 0
        for batch in batches:
            label = batch.column("y").to_numpy()
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                starts, _, rows, bucket, of = instances(raw, offs)
                buckets.append(bucket)
                sentence.append(of + n_sentences)
                bag.append(rows + len(y))
                n_sentences += len(starts)
                y += label[lo:hi].tolist()
        if not y:
            return
        w, bias = fit(np.concatenate(buckets), np.concatenate(sentence), np.concatenate(bag), np.array(y))
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "bias": [float(bias)]})

    found = sample.repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    if not found:
        return np.zeros(BUCKETS, dtype=np.float32), START_BIAS
    return np.frombuffer(found[0].weights, dtype=np.float32), found[0].bias


def _sentence_logits(model, raw: np.ndarray, offs: np.ndarray):
    w, bias = model
    starts, ends, rows, bucket, of = instances(raw, offs)
    return starts, ends, rows, bias + np.bincount(of, weights=w[bucket], minlength=len(starts))


def scores(texts: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, n_offending, worst_start, worst_end): byte offsets of the sentence with the highest probability."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score, offending = np.zeros(n), np.zeros(n, dtype=np.int32)
            worst = np.full((2, n), -1, dtype=np.int64)
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                starts, ends, rows, z = _sentence_logits(shared.value, raw, offs)
                score[lo:hi] = -np.expm1(-np.bincount(rows, weights=_softplus(z), minlength=hi - lo))
                offending[lo:hi] = np.bincount(rows[z >= 0], minlength=hi - lo)
                order = np.lexsort((-np.arange(len(z)), z, rows))
                top = order[np.flatnonzero(np.diff(rows[order], append=-1))]  # the last of each row: the highest
                worst[:, lo + rows[top]] = starts[top] - offs[rows[top]], ends[top] - offs[rows[top]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(offending), *(pa.array(x, mask=x < 0) for x in worst)],
                names=["doc_id", "score", "n_offending", "worst_start", "worst_end"],
            )

    return texts.mapInArrow(run, "doc_id long, score double, n_offending int, worst_start long, worst_end long")


def sentences(texts: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, score) of every sentence whose own probability is ``least`` or more."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, _, raw, offs in text_blocks(batch.column("text")):
                starts, ends, rows, z = _sentence_logits(shared.value, raw, offs)
                p = 1.0 / (1.0 + np.exp(-z))
                data = raw.tobytes()
                hit = np.flatnonzero(p >= least).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[lo + rows[i]] for i in hit], pa.int64()),
                        pa.array([data[starts[i] : ends[i]].decode("utf-8", "replace").strip() for i in hit], pa.string()),
                        pa.array([float(p[i]) for i in hit], pa.float64()),
                    ],
                    names=["doc_id", "sentence", "score"],
                )

    return texts.mapInArrow(run, "doc_id long, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and where the worst sentence is."""
    model = train(labelled_sample(docs, labels, "toxic", FOLDS, HELD_FOLD, TRAIN_ROWS))
    out = scores(texts_of(docs), model)
    return out.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with every column; nothing is shuffled."""
    model = train(labelled_sample(docs, labels, "toxic", FOLDS, HELD_FOLD, TRAIN_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = pa.array(batch.column(batch.schema.get_field_index("text")))
            for lo, hi, raw, offs in text_blocks(column):
                _, _, rows, z = _sentence_logits(shared.value, raw, offs)
                score = -np.expm1(-np.bincount(rows, weights=_softplus(z), minlength=hi - lo))
                yield batch.slice(lo, hi - lo).filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
