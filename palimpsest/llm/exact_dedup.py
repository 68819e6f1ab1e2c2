"""Exact dedup with counting quotient filters (operator 10).

Texts are equal when identical after deleting ASCII white space. Each partition builds a counting
quotient filter over 64-bit fingerprints of its normalised texts: the high bits (quotient) choose a
slot, the slot holds the sorted low bits (remainders) with counts. The filters of a slot merge
losslessly: their sorted remainders become one sorted row, and counts of equal ones add up. Slots are
as many as keep a merged row near ``SLOT_ENTRIES`` remainders.

Fingerprints counted more than once are suspects. A bitmap of their quotients (sized by their number,
2**MOST_BITS bits at most) lets a scan pass most other texts by; a semi-join on the fingerprint takes
out what it lets through. The suspects' normalised bytes meet in one group-by, whose key is the bytes
themselves; equal texts of one batch travel once, so a text held by a third of all rows is no hot key.

Defined results: null text counts as empty; all empty texts are one group; of equal rows (same id
and text) exactly one stays; a null id sorts after all others; other columns of the input,
whatever their names, are carried by :func:`drop_duplicates` and ignored otherwise; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, staged, table, text_blocks, texts_of

#: Remainders of a slot, about, when all filters are merged; and the fewest slots, as a power of two.
SLOT_ENTRIES = 1 << 16
LEAST_SLOT_BITS = 8
#: Bits of the suspects' bitmap for each suspect, and the most of it, as a power of two (32 MB).
BITS_EACH = 16
MOST_BITS = 28


def _normal(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def normal_text(text: Column) -> Column:
    """The same as a column expression."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _texts(column: pa.Array) -> Iterator[bytes]:
    for _, _, raw, offs in text_blocks(column):
        data = raw.tobytes()
        for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
            yield data[s:e]


def fingerprints(texts: DataFrame) -> DataFrame:
    """(doc_id, fp, text_sha256, n_cp): the fingerprint and digest of each normalised text."""

    def run(batches):
        for batch in batches:
            fp, sha, n = [], [], []
            for text in _texts(batch.column("text")):
                normal = _normal(text)
                fp.append(xxhash.xxh3_64_intdigest(normal))
                sha.append(hashlib.sha256(normal).hexdigest())
                n.append(len(text.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array(fp, dtype=np.uint64).view(np.int64)),
                    pa.array(sha, pa.string()),
                    pa.array(n, pa.int64()),
                ],
                names=["doc_id", "fp", "text_sha256", "n_cp"],
            )

    return texts.mapInArrow(run, "doc_id long, fp long, text_sha256 string, n_cp long")


def slot_bits(rows: int) -> int:
    """Bits of the quotient that name a slot, for so many fingerprints."""
    return max(LEAST_SLOT_BITS, (max(rows, 1) // SLOT_ENTRIES).bit_length())


FILTER = "slot int, remainders array<long>, counts array<long>"


def counting_filters(fps: DataFrame, bits: int) -> DataFrame:
    """One counting quotient filter for each partition of ``fps`` (fp long), a row for each slot that has any.

    Rows as ``FILTER``: remainders sorted, without repeats.
    """
    low = 64 - bits

    def run(batches):
        seen = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen).view(np.uint64), return_counts=True)
        slots = (values >> np.uint64(low)).astype(np.int32)
        remainders = (values & np.uint64((1 << low) - 1)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(slots, prepend=-1))
        ends = np.append(cuts, len(slots)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slots[cuts]),
                pa.ListArray.from_arrays(ends, pa.array(remainders)),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
            ],
            names=["slot", "remainders", "counts"],
        )

    return fps.select("fp").mapInArrow(run, FILTER)


def merged_filters(filters: DataFrame) -> DataFrame:
    """The filter of all of ``filters``: one row for each slot, by merging the sorted remainders of its rows."""

    def merge(rows: pa.Table) -> pa.Table:
        remainders, counts = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("remainders", "counts"))
        order = np.argsort(remainders, kind="stable")  # a merge of sorted runs
        remainders, counts = remainders[order], counts[order]
        first = np.flatnonzero(np.diff(remainders, prepend=-1))
        merged = [remainders[first].tolist(), np.add.reduceat(counts, first).tolist()]
        slot = rows.column("slot").slice(0, 1)
        return pa.table({"slot": slot, "remainders": pa.array([merged[0]], pa.list_(pa.int64())), "counts": pa.array([merged[1]], pa.list_(pa.int64()))})

    return filters.groupBy("slot").applyInArrow(merge, FILTER)


def copies(merged: DataFrame, bits: int) -> DataFrame:
    """(fp, copies) of a merged filter: quotient and remainder together are the fingerprint."""
    entry = merged.select("slot", F.explode(F.arrays_zip("remainders", "counts")).alias("e"))
    return entry.select(F.shiftleft(F.col("slot").cast("long"), 64 - bits).bitwiseOR(F.col("e.remainders")).alias("fp"), F.col("e.counts").alias("copies"))


def suspects_of(fps: DataFrame) -> DataFrame:
    """(fp) counted more than once in ``fps`` (fp long), a table that is written."""
    bits = slot_bits(fps.count())
    return staged(copies(merged_filters(counting_filters(fps, bits)), bits).where("copies > 1").select("fp"))


def quotient_bitmap(suspects: DataFrame) -> np.ndarray:
    """The quotients that a suspect has, as bits in 64-bit words: 2**MOST_BITS bits at most, whatever the input."""
    bits = min(MOST_BITS, max(16, (suspects.count() * BITS_EACH).bit_length()))
    shift = 64 - bits
    words = (
        suspects.groupBy(F.shiftrightunsigned("fp", shift + 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {shift}) & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def hit(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the quotient of each of ``fp``."""
    q = fp >> np.uint64(64 - 6 - (len(bitmap).bit_length() - 1))
    return (bitmap[(q >> np.uint64(6)).astype(np.int64)] >> (q & np.uint64(63))) & np.uint64(1) == 1


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of ``keys`` (fp), rows that surely have none), by the bitmap of the keys' quotients.

    ``key`` is a hash, spread evenly over 64 bits. Only the first rows need a join with what the keys stand for.
    """
    shared = rows.sparkSession.sparkContext.broadcast(quotient_bitmap(keys))

    def may(column: pd.Series) -> pd.Series:
        return pd.Series(hit(shared.value, column.to_numpy().view(np.uint64)))

    known = F.pandas_udf(may, "boolean")(key)
    return rows.where(known), rows.where(~known)


def suspect_texts(texts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(fp, text_sha256, normal, n) of the texts with a suspect fingerprint; equal ones of a batch are one row."""
    shared = texts.sparkSession.sparkContext.broadcast(quotient_bitmap(suspects))

    def run(batches):
        for batch in batches:
            held: Counter[tuple[int, bytes]] = Counter()
            normals = [_normal(t) for t in _texts(batch.column("text"))]
            fp = np.array([xxhash.xxh3_64_intdigest(x) for x in normals], dtype=np.uint64)
            for i in np.flatnonzero(hit(shared.value, fp)).tolist() if len(fp) else ():
                held[int(fp[i]), normals[i]] += 1
            rows = list(held.items())
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([k for (k, _), _ in part], dtype=np.uint64).view(np.int64)),
                        pa.array([hashlib.sha256(x).hexdigest() for (_, x), _ in part], pa.string()),
                        pa.array([x for (_, x), _ in part], pa.binary()),
                        pa.array([n for _, n in part], pa.int64()),
                    ],
                    names=["fp", "text_sha256", "normal", "n"],
                )

    return texts.mapInArrow(run, "fp long, text_sha256 string, normal binary, n long").join(suspects, "fp", "left_semi")


def _one_text(copies: str, texts: str):
    return F.when(F.col(texts) > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col(copies))


def verified_groups(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, fp, text_sha256, n_cp, row), and the groups of two and more equal texts as
    (text_sha256, group_size, keep_id, keep_cp, keep_row)."""
    small = staged(fingerprints(texts).withColumn("row", F.monotonically_increasing_id()))
    suspects = suspects_of(small)
    # the group key holds the bytes: rows fall together only when the texts are identical
    verified = (
        suspect_texts(texts, suspects)
        .groupBy("text_sha256", "normal")
        .agg(F.sum("n").alias("n"))
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))
        .select("text_sha256", _one_text("n", "n_texts").alias("group_size"))
        .where("group_size > 1")
    )
    best = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    keepers = small.join(suspects, "fp", "left_semi").groupBy("text_sha256").agg(best.alias("best"))
    groups = verified.join(keepers, "text_sha256")
    return small, staged(groups.select("text_sha256", "group_size", "best.keep_id", (-F.col("best.a")).alias("keep_cp"), "best.keep_row"))


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the
    smallest id.
    """
    small, groups = verified_groups(texts_of(docs, id_col, text_col))
    out = small.join(groups, "text_sha256", "left")
    grouped = F.col("group_size").isNotNull()
    return out.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (~grouped | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with every column of ``docs``.

    The choice is made on narrow rows; texts move once to be verified, if suspect. Of whole rows only those move that have the
    id of one that goes (told by a bitmap), to leave by an anti-join. Rows are told apart by id, digest and length, so the
    input may come in another order each time it is read.
    """
    small, groups = verified_groups(texts_of(docs, id_col, text_col))
    held = small.join(groups, "text_sha256").select("doc_id", "text_sha256", "n_cp", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))).alias("first"))
    told = staged(held.groupBy("doc_id", "text_sha256", "n_cp", "first").agg(F.count("*").alias("rows")))
    docs, others = split_by_keys(docs, F.xxhash64(docs[id_col].cast("long")), told.where("NOT first OR rows > 1").select(F.xxhash64("doc_id").alias("fp")))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def with_key(rows: DataFrame, how: str) -> DataFrame:
        keys = rows.select(*[F.col(c).alias(f"{c}{mark}") for c in ("doc_id", "text_sha256", "n_cp")])
        same_text = (F.sha2(normal_text(docs[text_col]).cast("binary"), 256) == keys[f"text_sha256{mark}"]) & (F.char_length(text) == keys[f"n_cp{mark}"])
        keys = keys.hint("merge")  # they grow with the input: the same plan at every size
        return docs.join(keys, docs[id_col].cast("long").eqNullSafe(keys[f"doc_id{mark}"]) & same_text, how)

    mark = "_" * (1 + max(len(c) for c in docs.columns))  # no column has such a name
    repeated = told.where("first AND rows > 1")
    if repeated.isEmpty():
        return with_key(told.where("NOT first"), "left_anti").unionByName(others)
    # rows alike in id and text: one of each, whichever comes first
    one = with_key(repeated, "inner").groupBy(*[f"{c}{mark}" for c in ("doc_id", "text_sha256", "n_cp")]).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias(f"row{mark}"))
    return with_key(told.where("NOT first OR rows > 1"), "left_anti").unionByName(one.select(f"row{mark}.*")).unionByName(others)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(table(spark, sf_dir, "documents"))


#: DuckDB: the same rows by grouping the normalised texts themselves.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size
  FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
