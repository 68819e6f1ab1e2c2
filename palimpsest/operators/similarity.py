"""Similarity of texts: exact upper bounds in SQL, exact matching in Arrow batches.

The ratio is 2 M / T of the longest-matching-block recursion over words, left before right (it isn't
symmetric). Its two upper bounds need only word counts, so a join filters by them before any pair is
aligned, and loses none that reaches the floor.
"""

from __future__ import annotations

import bisect
import difflib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import bound, comparison_text
from .stages import staged


def words(text: Column) -> Column:
    return bound(comparison_text(text), lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")))


def length_bound(n_left: Column, n_right: Column) -> Column:
    """Upper bound by word numbers; two empty texts are alike."""
    return F.when(n_left + n_right == 0, F.lit(1.0)).otherwise(2.0 * F.least(n_left, n_right) / F.nullif(n_left + n_right, F.lit(0)))


def word_counts(nodes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, n) of each node."""
    return nodes.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def bounds(pairs: DataFrame, nodes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(left, right, real_quick, quick): both bounds of each pair of keys, by joins on word counts.

    Only nodes that some pair names are cut into words.
    """
    named = pairs.select(F.col("left").alias(key)).union(pairs.select("right")).distinct()
    used = nodes.join(named, key, "left_semi").select(key, text)
    sizes = used.select(F.col(key).alias("k"), F.size(words(F.col(text))).cast("long").alias("n"))
    counts = word_counts(used, key, text)
    left = counts.select(F.col(key).alias("left"), "word", F.col("n").alias("nl"))
    right = counts.select(F.col(key).alias("right"), "word", F.col("n").alias("nr"))
    shared = pairs.join(left, "left").join(right, ["right", "word"]).groupBy("left", "right").agg(F.sum(F.least("nl", "nr")).alias("m"))
    out = pairs.join(sizes.withColumnsRenamed({"k": "left", "n": "n_left"}), "left").join(sizes.withColumnsRenamed({"k": "right", "n": "n_right"}), "right")
    out = out.join(shared, ["left", "right"], "left")
    total = F.col("n_left") + F.col("n_right")
    quick = F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.coalesce("m", F.lit(0)) / F.nullif(total, F.lit(0)))
    return out.select("left", "right", length_bound(F.col("n_left"), F.col("n_right")).alias("real_quick"), quick.alias("quick"))


def word_ratio(left: str, right: str) -> Column:
    """The ratio of two text columns over words."""

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(ratios, "double")(left, right)


#: Products of word counts up to which two runs of words are matched as they are, and words of an anchor in longer ones.
MATCHED, ANCHOR_WORDS = 25_000_000, 4


def _anchors(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places (in x, in y) of word runs that occur once in either, rising in both: the longest such chain."""

    def once(words_: list[str]) -> dict[tuple, int]:
        places: dict[tuple, int] = {}
        for i in range(len(words_) - ANCHOR_WORDS + 1):
            run = tuple(words_[i : i + ANCHOR_WORDS])
            places[run] = -1 if run in places else i
        return places

    right = once(y)
    pairs = [(i, right[run]) for run, i in once(x).items() if i >= 0 and right.get(run, -1) >= 0]
    tails: list[int] = []  # the lowest end in y of a chain of each length
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):  # in order of x, as dicts keep it
        at = bisect.bisect_left(tails, j)
        before[n] = ends[at - 1] if at else -1
        tails[at:at + 1], ends[at:at + 1] = [j], [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def opcodes(x: list[str], y: list[str]) -> list[tuple[str, int, int, int, int]]:
    """What runs of words two texts share and where they differ, as operations that turn ``x`` into ``y``, in order.

    Texts whose word counts multiply to more than ``MATCHED`` are cut at anchors first, word runs that both have once, and matched
    between them; a long stretch without an anchor is one replacement. Shorter ones are matched whole.
    """

    def matched(i: int, i_end: int, j: int, j_end: int):
        if (i_end - i) * (j_end - j) > MATCHED:
            yield "replace", i, i_end, j, j_end
            return
        for kind, a, b, c, d in difflib.SequenceMatcher(None, x[i:i_end], y[j:j_end], autojunk=False).get_opcodes():
            yield kind, i + a, i + b, j + c, j + d

    if len(x) * len(y) <= MATCHED:
        return list(matched(0, len(x), 0, len(y)))
    found: list[tuple[str, int, int, int, int]] = []

    def add(kind, i, i_end, j, j_end):
        if found and found[-1][0] == kind == "equal":
            i, j = found[-1][1], found[-1][3]
            found.pop()
        found.append((kind, i, i_end, j, j_end))

    at_x = at_y = 0
    for i, j in [*_anchors(x, y), (len(x), len(y))]:
        if i < at_x or j < at_y:  # overlaps the run before
            continue
        for op in matched(at_x, i, at_y, j):
            add(*op)
        at_x, at_y = i, j
        while at_x < len(x) and at_y < len(y) and x[at_x] == y[at_y]:
            at_x, at_y = at_x + 1, at_y + 1
        if at_x > i:
            add("equal", i, at_x, j, at_y)
    return found


def diff_spans(before: str, after: str) -> Column:
    """What word runs two text columns share and where they differ, in order."""

    def one(a: str, b: str):
        x, y = a.split(), b.split()
        return [{"kind": kind, "before": " ".join(x[i:j]), "after": " ".join(y[k:n])} for kind, i, j, k, n in opcodes(x, y)]

    def spans(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(spans, "array<struct<kind:string,before:string,after:string>>")(before, after)


def mutual_best(scored: DataFrame, floor: float) -> DataFrame:
    """Pairs with a ratio of ``floor`` or more that are each other's best; ties go to the lower name."""
    enough = scored.where(F.col("ratio") >= floor)
    best_right = Window.partitionBy("left").orderBy(F.desc("ratio"), "right")
    best_left = Window.partitionBy("right").orderBy(F.desc("ratio"), "left")
    return enough.withColumns({"_r": F.row_number().over(best_right), "_l": F.row_number().over(best_left)}).where("_r = 1 AND _l = 1").drop("_r", "_l")


#: Texts whose word pairs are counted to rank pairs by how rare they are, about; and the slots of that count (8 bytes each).
SAMPLE_TEXTS = 20_000
SKETCH_SLOTS = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _word_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of each word pair of a batch of texts, and how many words each text has."""
    cut = [(t or "").split() for t in column.to_pylist()]
    n = np.array([len(w) for w in cut], dtype=np.int64)
    words_ = np.array([w for one in cut for w in one], dtype=object)
    if len(words_) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), n
    h = pd.util.hash_array(words_)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(row[1:] == row[:-1])
    return row[inside], _mixed(h[inside] * _A + h[inside + 1]), n


def _sketch(nodes: DataFrame, text: str, total: int) -> np.ndarray:
    """How often word pairs occur, by slots of their hashes, in some ``SAMPLE_TEXTS`` of the texts: it orders pairs and decides nothing."""

    def run(batches):
        held = np.zeros(SKETCH_SLOTS, dtype=np.int64)
        for batch in batches:
            _, h, _ = _word_pairs(batch.column(0))
            held += np.bincount((h % np.uint64(SKETCH_SLOTS)).astype(np.int64), minlength=SKETCH_SLOTS)
        slots = np.flatnonzero(held > 1)
        for at in range(0, len(slots), 100_000):
            part = slots[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], names=["slot", "n"])

    share = min(1.0, SAMPLE_TEXTS / max(1, total))
    drawn = nodes.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(share * 1_000_000)).select(text)
    counts = drawn.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH_SLOTS, dtype=np.int64)
    out[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return out


#: Word pairs that are held against each other at once, about, and pairs of texts that are kept until repeats are left out.
BUCKET_TOKENS, HELD_PAIRS = 2_000_000, 4_000_000


def _pack(ids: np.ndarray, n: np.ndarray, side: np.ndarray, count: np.ndarray, tokens: np.ndarray) -> bytes:
    head = zlib.compress(b"".join(x.astype(np.int64).tobytes() for x in (np.diff(ids, prepend=0), n, side, count)), 1)
    return np.array([len(head), len(ids)], np.int64).tobytes() + head + tokens.tobytes()


def _unpack(held: bytes) -> tuple[np.ndarray, ...]:
    size, rows = np.frombuffer(held, np.int64, 2)
    ids, n, side, count = np.frombuffer(zlib.decompress(held[16 : 16 + size]), np.int64).reshape(4, rows)
    return np.cumsum(ids), n, side, count, np.frombuffer(held, np.uint32, offset=16 + int(size))


def prefixes(nodes: DataFrame, key: str, side: str, text: str, floor: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, held): the rarest word pairs of each text, as many as it may lack of a text alike and one more, dealt by hash.

    A word pair's repeats count as pairs of their own, and those of other ``within`` are others. ``held`` has (key, words, side, word
    pairs) of many texts, packed: four bytes a word pair, so what meets by them may, rarely, have none in common.
    """
    least = floor / (2 - floor)
    total, size = nodes.agg(F.count("*"), F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = np.uint64(max(parts, size // 15 // BUCKET_TOKENS + 1))  # some fifteen characters for each of a text's rarest pairs
    shared = nodes.sparkSession.sparkContext.broadcast(_sketch(nodes, text, total))
    rows = nodes.select(F.col(key).cast("long").alias("_key"), F.xxhash64(side).alias("_side"), (F.xxhash64(*within) if within else F.lit(0).cast("long")).alias("_within"), F.col(text).alias("_text"))

    def run(batches):
        often = shared.value
        for batch in batches:
            row, h, n = _word_pairs(batch.column("_text"))
            if not len(h):
                continue
            ids, sides, apart = (batch.column(c).to_numpy() for c in ("_key", "_side", "_within"))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
            repeat = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
            token = _mixed(h + repeat.astype(np.uint64) * _C)
            rank = np.lexsort((token, often[(h % np.uint64(SKETCH_SLOTS)).astype(np.int64)], row))
            row, token = row[rank], token[rank]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            common = np.maximum(np.ceil((1.5 * floor - 1) * (1 + least) * n - 1 - 1e-9), 1)
            chosen = place <= np.maximum(n - 1 - common, 0)[row]
            row, token = row[chosen], token[chosen]
            token = _mixed(token ^ apart[row].view(np.uint64))
            bucket = (token % buckets).astype(np.int64)
            order = np.lexsort((row, bucket))
            row, bucket, short = row[order], bucket[order], (token[order] >> np.uint64(32)).astype(np.uint32)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            held = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own, count = np.unique(row[lo:hi], return_counts=True)
                held.append(_pack(ids[own], n[own], sides[own], count, short[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(held, pa.binary())], names=["bucket", "held"])

    return rows.mapInArrow(run, "bucket long, held binary")


def _meeting(held: list[bytes], least: float):
    """(left, right) keys of the texts of a bucket that have a word pair in common, are of two sides and not too far apart in length."""
    ids, n, side, count, tokens = (np.concatenate(x) for x in zip(*map(_unpack, held)))
    order = np.argsort(ids, kind="stable")  # places in order of keys, so a pair is one number
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.repeat(rank, count)
    ids, n, side = ids[order], n[order], side[order]
    order = np.lexsort((n[at], tokens))
    at, tokens = at[order], tokens[order]
    found = np.zeros(0, np.int64)
    fresh: list[np.ndarray] = []
    size, step, i = 0, 1, np.arange(len(at))
    while True:
        i = i[i + step < len(at)]
        i = i[tokens[i] == tokens[i + step]]
        x, y = at[i], at[i + step]
        near = n[x] >= least * n[y] - 1e-9  # of one word pair texts come in order of length: what is too long stays so
        i, x, y = i[near], x[near], y[near]
        if not len(i):
            break
        good = side[x] != side[y]
        pairs = np.unique(np.minimum(x[good], y[good]) * len(ids) + np.maximum(x[good], y[good]))
        fresh.append(pairs)
        size += len(pairs)
        if size > HELD_PAIRS:
            found, fresh, size = np.unique(np.concatenate([found, *fresh])), [], 0
            if len(found) > 4 * HELD_PAIRS:
                yield ids[found // len(ids)], ids[found % len(ids)]
                found = found[:0]
        step += 1
    found = np.unique(np.concatenate([found, *fresh]))
    if len(found):
        yield ids[found // len(ids)], ids[found % len(ids)]


def candidates(nodes: DataFrame, key: str, side: str, text: str = "text", floor: float = 0.9, within: tuple[str, ...] = ()) -> DataFrame:
    """(left, right): pairs of nodes of two sides, in order of ``key``, with all whose texts differ and have a ratio of ``floor`` or more.

    ``key`` is a whole number of 64 bits that names a node, ``text`` a comparison text; nodes equal in ``within`` are paired and, by
    chance of a hash, a few others. Two texts of S words in all that leave at most
    (1 - floor) S of them unmatched share a bag of (1.5 floor - 1) S - 1 word pairs at least, as each unmatched word ends one
    block of matches at most. Neither text is shorter than floor / (2 - floor) of the other, so S is bounded by one of them,
    and the rarest word pairs of each, up to as many as it may lack plus one, have one in common, whatever the order is that
    says which is rarer. Different texts have S >= 1 / (1 - floor), so above a floor of 0.8 the bag is never empty. No common
    pair is passed over; a family of distinct near copies makes all its pairs, which qualify or nearly so.
    """
    if floor <= 0.8:
        raise ValueError("the bound needs a floor above 0.8")
    least = floor / (2 - floor)

    def met(group: pa.Table) -> pa.Table:
        pairs = [pa.table({"left": x, "right": y}) for x, y in _meeting(group.column("held").to_pylist(), least)]
        return pa.concat_tables(pairs) if pairs else pa.table({"left": pa.array([], pa.int64()), "right": pa.array([], pa.int64())})

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few bytes make many pairs
    return prefixes(nodes, key, side, text, floor, within).repartition(parts, "bucket").groupBy("bucket").applyInArrow(met, "left long, right long").distinct()


#: Pairs of one block of a family, about.
BLOCK_PAIRS = 4096


def paired_ratios(pairs: DataFrame, nodes: DataFrame, key: str, text: str, floor: float) -> DataFrame:
    """(left, right, ratio): the ratios over words of pairs (left, right) of whole-number keys, of those that reach ``floor``.

    Pairs that share neighbours are dealt together, large families in blocks, so a text moves once for a block and not for each of
    its pairs.
    """
    ends = pairs.select(F.col("left").alias("x"), F.col("right").alias("y"))
    lowest = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.least("x", F.min("y")).alias("low"))
    named = pairs.select("left", "right")
    for end in ("left", "right"):
        named = named.join(lowest.select(F.col("x").alias(end), F.col("low").alias(f"{end}_low")), end)
    named = staged(named.select("left", "right", F.least("left_low", "right_low").alias("family")))
    large = named.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_PAIRS).select("family", F.ceil(F.sqrt(F.col("n") / BLOCK_PAIRS)).alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    dealt = staged(named.join(large, "family", "left").select(F.xxhash64("family", *[F.pmod(F.xxhash64(end), cuts) for end in ("left", "right")]).alias("block"), "left", "right"))
    wanted = dealt.select("block", F.col("left").alias("x")).unionByName(dealt.select("block", F.col("right").alias("x"))).distinct()
    texts = wanted.join(nodes.select(F.col(key).alias("x"), F.col(text).alias("text")), "x").select("block", F.lit(None).cast("long").alias("y"), "x", "text")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few bytes take long to match
    rows = texts.unionByName(dealt.select("block", F.col("right").alias("y"), F.col("left").alias("x"), F.lit(None).cast("string").alias("text")))
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", F.col("y").asc_nulls_first(), "x")

    def run(batches):
        block, words_, second = None, {}, None
        found = difflib.SequenceMatcher(None, autojunk=False)
        for batch in batches:
            out: list[tuple] = []
            for where, y, x, own in zip(*(batch.column(c).to_pylist() for c in ("block", "y", "x", "text"))):
                if where != block:
                    block, words_, second = where, {}, None
                if y is None:  # the texts of a block come before its pairs
                    words_[x] = own.split()
                    continue
                if y != second:
                    found.set_seq2(words_[y])
                    second = y
                found.set_seq1(words_[x])
                if found.real_quick_ratio() >= floor and found.quick_ratio() >= floor and (ratio := found.ratio()) >= floor:
                    out.append((x, y, ratio))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["left", "right", "ratio"])

    return rows.mapInArrow(run, "left long, right long, ratio double")


def equal_pairs(nodes: DataFrame, key: str, same: str) -> DataFrame:
    """(left, right): of nodes of equal ``same``, the first with each other and neighbours with each other.

    These few rows have the same mutual best pairs as all pairs would.
    """
    w = Window.partitionBy(same).orderBy(key)
    each = nodes.select(F.first(key).over(w).alias("_first"), F.lag(key).over(w).alias("_before"), F.col(key).alias("right")).where("_before IS NOT NULL")
    return each.select("_first", "right").union(each.select("_before", "right")).distinct().toDF("left", "right")
