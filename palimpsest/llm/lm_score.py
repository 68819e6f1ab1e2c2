"""Stupid-backoff scores of a bigram model counted on the corpus itself (operator 4).

Words are lower-cased (A-Z). A bigram counted ``LEAST`` times or more scores c(v w) / c(v); any other
backs off to ``BACKOFF`` times c(w) / N; the first word of a document scores c(w) / N. A document's
``log_prob`` is the sum of natural logarithms, ``score`` its mean over words.

The n-grams of all documents are exploded once and dealt by hash, so each part holds the whole count
table of its n-grams next to every use of them: counting and joining are one pass over the part, and
only sums per document leave it. A rare word's part is by its hash; a bigram goes to the part of its
rare word, to both if both are rare (one side scores it if it is counted, the other backs off), and by
its own hash if neither is. So every count that a bigram needs is in its part or is a frequent one.

Frequent words and bigrams would make hot parts. Those with a share of ``SHARE`` of all words or more
are counted beforehand: a task reports what has half that share of its own words, what is reported
often enough is a candidate (2 / SHARE of each kind at most, whatever the corpus), and candidates are
counted exactly. That table is broadcast; frequent bigrams never leave their document's task.

The n-grams travel as arrays, one row for each block of documents, kind and part, which takes a
third of the shuffle that a row for each n-gram takes.

Defined results: null and blank texts have n_words 0, log_prob 0 and a null score; repeated rows are
each scored and each counted; ids don't matter to the scores and may be null; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, mix64, span_hashes, table, text_blocks, texts_of, word_spans

BACKOFF = 0.4
LEAST = 2
SHARE = 1e-5
#: Words of a block of documents, about, and documents at most.
BLOCK_WORDS = 2_000_000
BLOCK_ROWS = 30_000
#: N-grams of a part, about.
PART_GRAMS = 2_000_000

WORD, PAIR, ALL = 0, 1, 2
#: Kinds of n-grams that travel, by which words are frequent.
BOTH_FREQUENT, FREQUENT_SECOND, FREQUENT_FIRST, RARE_BY_SECOND, RARE_BY_FIRST, RARE_START, SUMS = range(7)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + mix64(second))


def _blocks(batches):
    """(number, ids, words, rows): hashes of the words of a block of documents and each word's row in it.

    A block's number is its task's partition and its place there, so a task that runs again gives the
    same numbers.
    """
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 24
    ids, words, rows, n_words = [], [], [], 0
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        # a slice has less rows than a block, so a block's places fit its arrays
        slices = ((at, part) for at in range(0, batch.num_rows, 8192) for part in text_blocks(batch.column("text").slice(at, 8192)))
        for at, (lo, hi, raw, offs) in slices:
            lo, hi = lo + at, hi + at
            if ids and (n_words > BLOCK_WORDS or len(ids) + hi - lo > BLOCK_ROWS):
                yield number, ids, np.concatenate(words), np.concatenate(rows)
                number, ids, words, rows, n_words = number + 1, [], [], [], 0
            s, e, r = word_spans(raw, offs)
            words.append(span_hashes(ascii_lower(raw), s, e))
            rows.append(r + len(ids))
            ids += doc_ids[lo:hi]
            n_words += len(s)
    if ids:
        yield number, ids, np.concatenate(words), np.concatenate(rows)


def _inner(rows: np.ndarray) -> np.ndarray:
    """Where a word has the word before it in the same document."""
    out = np.zeros(len(rows), dtype=bool)
    out[1:] = rows[1:] == rows[:-1]
    return out


def _keys(words: np.ndarray, rows: np.ndarray):
    """(kind, keys): the words, and the bigrams' hashes."""
    inner = _inner(rows)
    yield WORD, words
    yield PAIR, pair_hash(words[:-1][inner[1:]], words[inner])


def _counted(texts: DataFrame, pick) -> DataFrame:
    """(kind, key, n) summed over all blocks; ``pick`` chooses which of a block's counts are reported."""

    def run(batches):
        for _, _, words, rows in _blocks(batches):
            for kind, keys in _keys(words, rows):
                values, counts = np.unique(keys, return_counts=True)
                use = pick(kind, values, counts, len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(use.sum(), kind, np.int32)), pa.array(values[use].view(np.int64)), pa.array(counts[use].astype(np.int64))], names=["kind", "key", "n"]
                )
            yield pa.RecordBatch.from_arrays([pa.array([ALL], pa.int32()), pa.array([0], pa.int64()), pa.array([len(words)], pa.int64())], names=["kind", "key", "n"])

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _sorted(found: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    mine = found.column("kind").to_numpy() == kind
    keys, n = found.column("key").to_numpy()[mine].view(np.uint64), found.column("n").to_numpy()[mine]
    order = np.argsort(keys)
    return keys[order], n[order]


def frequent(texts: DataFrame, share: float) -> tuple[int, tuple, tuple]:
    """(words in all, (frequent words, counts), (frequent bigrams, counts)): sorted by key, counts exact."""
    reported = _counted(texts, lambda kind, values, counts, n: counts >= share / 2 * n).persist()
    try:
        total = reported.where(F.col("kind") == ALL).select("n").first()
        total = total.n if total else 0
        candidates = reported.where((F.col("kind") != ALL) & (F.col("n") >= share / 2 * total)).toArrow()  # 2 / share of each kind at most
    finally:
        reported.unpersist()
    wanted = {kind: _sorted(candidates, kind)[0] for kind in (WORD, PAIR)}
    held = texts.sparkSession.sparkContext.broadcast(wanted)
    exact = _counted(texts, lambda kind, values, counts, n: np.isin(values, held.value[kind])).where(F.col("kind") != ALL).toArrow()
    return total, _sorted(exact, WORD), _sorted(exact, PAIR)


def _find(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in a sorted table, -1 if it isn't there."""
    if not len(table_):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return np.where(table_[at] == keys, at, -1)


SHIPPED = "part int, kind int, first long, keys array<long>, others array<long>, small array<int>, local array<short>, ids array<long>, sums array<double>"
_FIELDS = pa.schema(
    [("part", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("keys", pa.list_(pa.int64())), ("others", pa.list_(pa.int64())), ("small", pa.list_(pa.int32())), ("local", pa.list_(pa.int16())), ("ids", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64()))]
)


def _shipped(kind: int, first: int, parts: np.ndarray, labels: np.ndarray, local, keys=None, others=None, small=None, ids=None, sums=None):
    """The record batch of one kind: a row for each part that has any."""
    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    cuts = np.flatnonzero(np.diff(parts, prepend=-1))
    ends = pa.array(np.append(cuts, len(parts)).astype(np.int32))
    n = len(cuts)

    def column(values, type_):
        if values is None:
            return pa.nulls(n, pa.list_(type_))
        if isinstance(values, list):
            return pa.ListArray.from_arrays(ends, pa.array(values, type_).take(pa.array(order)))
        return pa.ListArray.from_arrays(ends, pa.array(values[order], type_))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(labels[parts[cuts]], pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, first, np.int64)),
            column(None if keys is None else keys.view(np.int64), pa.int64()), column(None if others is None else others.view(np.int64), pa.int64()),
            column(small, pa.int32()), column(local, pa.int16()), column(ids, pa.int64()), column(sums, pa.float64()),
        ],
        schema=_FIELDS,
    )


def exploded(texts: DataFrame, model, labels: np.ndarray) -> DataFrame:
    """The n-grams of all documents by part, and what their frequent ones sum to."""
    held = texts.sparkSession.sparkContext.broadcast((model, labels))

    def run(batches):
        (total, (words_, word_n), (pairs_, pair_n)), labels = held.value
        log_word, log_pair, log_all = np.log(word_n), np.log(pair_n), math.log(max(total, 1))
        n_parts = np.uint64(len(labels))

        def part(h):
            return (h % n_parts).astype(np.int64)

        for first, ids, words, rows in _blocks(batches):
            inner = _inner(rows)
            place = _find(words_, words)
            sums = np.zeros(len(ids))
            start = np.flatnonzero(~inner)
            known = start[place[start] >= 0]
            sums += np.bincount(rows[known], weights=log_word[place[known]] - log_all, minlength=len(ids))
            rare = start[place[start] < 0]
            local = rows.astype(np.int16)
            yield _shipped(RARE_START, first, part(words[rare]), labels, local[rare], keys=words[rare])
            second = np.flatnonzero(inner)
            pair = _find(pairs_, pair_hash(words[second - 1], words[second]))
            hot = pair >= 0
            at = second[hot]
            # the words of a frequent bigram are at least as frequent; LEAST is well below any frequent count or is asked for
            counted = pair_n[pair[hot]] >= LEAST
            value = np.where(counted, log_pair[pair[hot]] - log_word[place[at - 1]], math.log(BACKOFF) + log_word[place[at]] - log_all)
            sums += np.bincount(rows[at], weights=value, minlength=len(ids))
            second = second[~hot]
            one, two = place[second - 1] >= 0, place[second] >= 0
            at = second[one & two]
            both = (place[at - 1].astype(np.uint64) << np.uint64(32)) | place[at].astype(np.uint64)
            yield _shipped(BOTH_FREQUENT, first, part(mix64(both)), labels, local[at], others=both)
            at = second[~one & two]
            yield _shipped(FREQUENT_SECOND, first, part(words[at - 1]), labels, local[at], keys=words[at - 1], small=place[at].astype(np.int32))
            at = second[one & ~two]
            yield _shipped(FREQUENT_FIRST, first, part(words[at]), labels, local[at], keys=words[at], small=place[at - 1].astype(np.int32))
            at = second[~one & ~two]
            yield _shipped(RARE_BY_SECOND, first, part(words[at]), labels, local[at], keys=words[at], others=words[at - 1])
            yield _shipped(RARE_BY_FIRST, first, part(words[at - 1]), labels, local[at], keys=words[at - 1], others=words[at])
            everyone = np.arange(len(ids))
            yield _shipped(SUMS, first, part(mix64((everyone + first).astype(np.uint64))), labels, everyone.astype(np.int16), others=np.bincount(rows, minlength=len(ids)).astype(np.int64), ids=ids, sums=sums)

    return texts.mapInArrow(run, SHIPPED)


def _part_sums(held: dict, model) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each n-gram use in one part, from its counts."""
    total, (_, word_n), _ = model
    log_word, log_all, log_backoff = np.log(word_n), math.log(max(total, 1)), math.log(BACKOFF)

    def uses(kind):
        parts = held.get(kind, [])
        return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(zip(*parts) if parts else ((), (), (), ()), (np.int64, np.uint64, np.uint64, np.int64))]

    def repeats(keys):
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return counts[back]

    rows, values = [], []
    row, _, both, _ = uses(BOTH_FREQUENT)
    c = repeats(both)
    one, two = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rows.append(row)
    values.append(np.where(c >= LEAST, np.log(c) - log_word[one], log_backoff + log_word[two] - log_all))
    start, first, rare2, rare1, second = (uses(k) for k in (RARE_START, FREQUENT_FIRST, RARE_BY_SECOND, RARE_BY_FIRST, FREQUENT_SECOND))
    words, counts = np.unique(np.concatenate([start[1], first[1], rare2[1]]), return_counts=True)
    log_rare = np.log(counts)

    def log_count(keys):
        return log_rare[np.searchsorted(words, keys)]

    rows.append(start[0])
    values.append(log_count(start[1]) - log_all)
    c = repeats(pair_hash(first[1], first[3].astype(np.uint64)))
    rows.append(first[0])
    values.append(np.where(c >= LEAST, np.log(c) - log_word[first[3]], log_backoff + log_count(first[1]) - log_all))
    c = repeats(pair_hash(second[1], second[3].astype(np.uint64)))
    rows.append(second[0])
    values.append(np.where(c >= LEAST, np.log(c) - log_count(second[1]), log_backoff + log_word[second[3]] - log_all))
    c = repeats(pair_hash(rare2[1], rare2[2]))
    rows.append(rare2[0])
    values.append(np.where(c >= LEAST, 0.0, log_backoff + log_count(rare2[1]) - log_all))
    c = repeats(pair_hash(rare1[1], rare1[2]))
    rows.append(rare1[0])
    values.append(np.where(c >= LEAST, np.log(c) - log_count(rare1[1]), 0.0))
    return np.concatenate(rows), np.concatenate(values)


def _flat(column: pa.Array, type_) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(type_, copy=False) if len(column) else np.zeros(0, type_)


SUMMED = "first long, local array<short>, sums array<double>, ids array<long>, words array<long>"


def _row_of(first: int, local, sums, ids=None, words=None) -> pa.RecordBatch:
    def cell(values, type_):
        return pa.array([values], pa.list_(type_))

    columns = [pa.array([first], pa.int64()), cell(local, pa.int16()), cell(sums, pa.float64()), cell(ids, pa.int64()), cell(words, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["first", "local", "sums", "ids", "words"])


def part_sums(shipped: DataFrame, model, parts: int) -> DataFrame:
    """Sums by document of each part, as one row for each block of documents and part."""
    held = shipped.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces: dict[int, dict] = {}
        sums_rows, sums_values = [], []
        for batch in batches:
            kinds, first, label = batch.column("kind").to_numpy(), batch.column("first").to_numpy(), batch.column("part").to_numpy()
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                local = _flat(one.column("local"), np.int64)
                if kinds[i] == SUMS:
                    yield _row_of(int(first[i]), local, _flat(one.column("sums"), np.float64), one.column("ids").flatten().to_pylist(), _flat(one.column("others"), np.int64))
                    continue
                # a block's number above, the document's place in it below
                row = first[i] * BLOCK_ROWS * 2 + local
                use = (row, _flat(one.column("keys"), np.int64).view(np.uint64), _flat(one.column("others"), np.int64).view(np.uint64), _flat(one.column("small"), np.int64))
                pieces.setdefault(int(label[i]), {}).setdefault(int(kinds[i]), []).append(use)
        while pieces:
            _, mine = pieces.popitem()
            row, value = _part_sums(mine, held.value)
            rows, back = np.unique(row, return_inverse=True)
            sums_rows.append(rows)
            sums_values.append(np.bincount(back, weights=value, minlength=len(rows)))
        if sums_rows:
            rows, back = np.unique(np.concatenate(sums_rows), return_inverse=True)
            values = np.bincount(back, weights=np.concatenate(sums_values), minlength=len(rows))
            block, local = rows // (BLOCK_ROWS * 2), rows % (BLOCK_ROWS * 2)
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(rows))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield _row_of(int(block[lo]), local[lo:hi], values[lo:hi])

    return shipped.repartition(parts, "part").mapInArrow(run, SUMMED)


def block_sums(summed: DataFrame, parts: int) -> DataFrame:
    """(doc_id, n_words, log_prob) of every document: its block's sums from all parts together."""

    def run(batches):
        blocks: dict[int, list] = {}
        for batch in batches:
            firsts = batch.column("first").to_pylist()
            for i, first in enumerate(firsts):
                one = batch.slice(i, 1)
                held = blocks.setdefault(first, (np.zeros(BLOCK_ROWS * 2), []))
                local = _flat(one.column("local"), np.int64)
                held[0][local] += _flat(one.column("sums"), np.float64)
                if one.column("ids").null_count == 0:
                    held[1].append((local, one.column("ids").flatten(), _flat(one.column("words"), np.int64)))
        while blocks:
            _, (sums, named) = blocks.popitem()
            for local, ids, words in named:
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(sums[local])], names=["doc_id", "n_words", "log_prob"])

    return summed.repartition(parts, "first").mapInArrow(run, "doc_id long, n_words long, log_prob double")


def _labels(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` partitions, a number that a hash partitioning puts there, so parts and partitions pair off."""
    span = 8 * parts
    while True:
        found = spark.range(span).select(F.col("id").cast("int").alias("n")).select("n", F.pmod(F.hash("n"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("n").alias("n")).orderBy("p").collect()
        if len(found) == parts:
            return np.array([r.n for r in found], dtype=np.int32)
        span *= 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per input row: doc_id, n_words, log_prob, score."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    model = frequent(texts, share)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), model[0] // PART_GRAMS)
    summed = part_sums(exploded(texts, model, _labels(spark, parts)), model, parts)
    return block_sums(summed, parts).select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
