"""Language identification with Viterbi over words (operator 3).

A word is a run of letters. Its script, by code point ranges, narrows the languages to those that use
the script in training; the others are not scored and can't be the word's. A word's score for a language is the sum of log probabilities of its letter
trigrams (hashed, smoothed, with word ends). Viterbi over a document's words, with a penalty for each
switch of language, labels spans of mixed-language text; the document's language is the one with most
letters, and the score its share of the letters.

Training counts come from at most ``TRAIN_ROWS`` documents of each language (chosen by a hash of the
id), counted by partition and summed; the predictions cover every row.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing was learned;
ties go to the first language by code point; repeated rows get the same answer each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, mix64, stable_shuffle, table, text_blocks, texts_of

#: Training documents of each language, at most.
TRAIN_ROWS = 4000
BUCKETS = 1 << 16
SMOOTHING = 0.2
SWITCH_PENALTY = 12.0
#: Letters that are scored at once.
SLICE = 1 << 16
#: Share of a language's training letters from which it is held to use a script.
SCRIPT_SHARE = 0.005
FOLDS, HELD_FOLD = 3, 1
UNKNOWN = "und"

#: First code points of script ranges, by Unicode block, and the script from there on.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1400, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x32000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _words(texts: list[str]):
    """Folded letters of the joined texts (0 between words), and each word's start, end and text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = _letters()[points]
    solid = folded > 0
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return folded, starts, ends, np.searchsorted(bounds, starts, side="right") - 1, bounds


def _trigrams(folded: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each position."""
    c = folded.astype(np.uint64)
    h = c.copy()
    h[1:] += c[:-1] << np.uint64(21)
    h[2:] += c[:-2] << np.uint64(42)
    h[2:][c[1:-1] == 0] &= np.uint64((1 << 42) - 1)  # nothing from before the word
    return (mix64(h) % np.uint64(BUCKETS)).astype(np.int64)


def _script(points: np.ndarray) -> np.ndarray:
    firsts = np.array([a for a, _ in SCRIPT_STARTS])
    names = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])
    return names[np.searchsorted(firsts, points, side="right") - 1]


def count(sample: DataFrame) -> DataFrame:
    """(lang, kind, bucket, n): trigrams (kind 0) and letters by script (kind 1) of (lang, text)."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        width = BUCKETS + len(SCRIPTS)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs.tolist()):
                chosen = [t for t, x in zip(texts, langs) if x == lang]
                for at in range(0, len(chosen), 200):
                    folded, starts, ends, _, _ = _words(chosen[at : at + 200])
                    inside = folded > 0
                    inside[ends] = True  # the word's end is part of its last trigram
                    sums = totals.setdefault(lang, np.zeros(width, dtype=np.int64))
                    sums[:BUCKETS] += np.bincount(_trigrams(folded)[inside], minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(_script(folded[starts]), weights=ends - starts, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array((at >= BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(sums[at])],
                names=["lang", "kind", "bucket", "n"],
            )

    counted = sample.mapInArrow(run, "lang string, kind int, bucket int, n long")
    return counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by bucket and language, candidates by script and language)."""
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (fold(docs["doc_id"], FOLDS) != HELD_FOLD))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))  # a row for each language
    share = (F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / F.col("rows")) * float(1 << 62) * 2).alias("below")
    sample = known.select("lang", "text", stable_shuffle(F.lit(3), "doc_id").alias("key")).join(F.broadcast(sizes.select("lang", share)), "lang").where("key < below")
    found = count(sample.select("lang", "text")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool)
    lang = np.searchsorted(np.array(langs, dtype=object), np.array(found.column("lang").to_pylist(), dtype=object))
    kind, bucket, n = (found.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    grams, letters = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    grams[bucket[kind == 0], lang[kind == 0]] = n[kind == 0]
    letters[bucket[kind == 1], lang[kind == 1]] = n[kind == 1]
    table_ = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=0) + SMOOTHING * BUCKETS)
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    # a script that no language uses narrows nothing
    return langs, table_.astype(np.float32), uses | ~uses.any(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, rows: np.ndarray, n_rows: int, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word; words are sorted by row. All rows advance word by word together."""
    sizes = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    langs = scores.shape[1]
    path = np.zeros(len(scores), dtype=np.int8 if langs < 127 else np.int32)
    if not len(scores):
        return path
    stay = np.zeros(scores.shape, dtype=bool)
    best_before = np.zeros_like(path)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # rows longer than each step
    state = np.zeros((n_rows, langs), dtype=np.float32)
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        s = state[:k]
        if t:
            top = s.argmax(axis=1)
            best_before[at] = top
            high = s[np.arange(k), top]
            s = s - high[:, None]  # keep numbers small
            stay[at] = s >= -penalty
            s = np.maximum(s, -penalty)
        state[:k] = s + scores[at]
    now = np.zeros(n_rows, dtype=path.dtype)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        begun = active[t + 1] if t + 1 < len(active) else 0
        now[begun:k] = state[begun:k].argmax(axis=1)  # rows that end here
        at = first[:k] + t
        path[at] = now[:k]
        if t:
            now[:k] = np.where(stay[at, now[:k]], now[:k], best_before[at])
    return path


def word_scores(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, table_: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Each word's score for each language; minus infinity for one that isn't a candidate of the word's script."""
    out = np.full((len(starts), table_.shape[1]), -np.inf, dtype=np.float32)
    if not len(starts):
        return out
    grams, script = _trigrams(folded), _script(folded[starts])
    for s in np.unique(script).tolist():
        words, langs = np.flatnonzero(script == s), np.flatnonzero(candidates[s])
        narrow = table_[:, langs]
        sizes = ends[words] + 1 - starts[words]  # with the word's end
        stops = np.cumsum(sizes)
        sums = np.zeros((len(words), len(langs)))
        for at in range(0, int(stops[-1]), SLICE):
            place = np.arange(at, min(at + SLICE, int(stops[-1])))
            word = np.searchsorted(stops, place, side="right")
            letter = starts[words[word]] + place - (stops[word] - sizes[word])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sums[word[first]] += np.add.reduceat(narrow[grams[letter]], first, axis=0, dtype=np.float64)
        out[np.ix_(words, langs)] = sums
    return out


def _label(texts: list[str], model):
    """(rows, (starts, ends), languages) of the words of a few texts."""
    _, table_, candidates = model
    folded, starts, ends, row, bounds = _words(texts)
    path = viterbi(word_scores(folded, starts, ends, table_, candidates), row, len(texts))
    return row, np.stack([starts - bounds[row], ends - bounds[row]]), path


def _decoded(column: pa.Array):
    """(first row, end row, texts) of runs of rows of about a block."""
    for lo, hi, raw, offs in text_blocks(column):
        data = raw.tobytes()
        yield lo, hi, [data[s:e].decode("utf-8", "replace") for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]


def predict(texts: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs = shared.value[0]
            if not langs:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32))], names=["doc_id", "lang_pred", "score", "n_spans"])
                continue
            for lo, hi, texts_ in _decoded(batch.column("text")):
                row, (start, end), path = _label(texts_, shared.value)
                n = hi - lo
                letters = np.bincount(row * len(langs) + path, weights=end - start, minlength=n * len(langs)).reshape(n, len(langs))
                whole = letters.sum(axis=1)
                best = letters.argmax(axis=1)
                turns = np.ones(len(row), dtype=bool)
                turns[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.array([langs[b] if w else UNKNOWN for b, w in zip(best, whole)], pa.string()),
                        pa.array(letters[np.arange(n), best] / np.maximum(whole, 1)),
                        pa.array(np.bincount(row[turns], minlength=n).astype(np.int32)),
                    ],
                    names=["doc_id", "lang_pred", "score", "n_spans"],
                )

    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans int")


def spans(texts: DataFrame, model) -> DataFrame:
    """(doc_id, start, end, lang): runs of words of one language, in code points."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs = shared.value[0]
            if not langs:
                continue
            for lo, _, texts_ in _decoded(batch.column("text")):
                row, (start, end), path = _label(texts_, shared.value)
                if not len(row):
                    continue
                turns = np.ones(len(row), dtype=bool)
                turns[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
                first = np.flatnonzero(turns)
                last = np.append(first[1:], len(row)) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(lo + row[first])), pa.array(start[first]), pa.array(end[last]), pa.array([langs[k] for k in path[first]], pa.string())],
                    names=["doc_id", "start", "end", "lang"],
                )

    return texts.mapInArrow(run, "doc_id long, start long, end long, lang string")


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_spans."""
    held = (fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out")
    return predict(texts_of(docs), train(docs)).select("doc_id", held, "lang_pred", "score", "n_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
