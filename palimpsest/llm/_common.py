"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space of the result contracts.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

#: Bytes of text that a kernel works on at once; a longer text is one block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a private one in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, so lost executors
    cost a read and not a second run, and every later use sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names, without nulls in the text."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z folded; bytes of longer characters stay."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def word_spans(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that ``inside`` marks (by default, not ASCII white space)."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~_IS_SPACE[raw] if inside is None else inside[raw]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    first = offs[:-1]
    before[first[first < len(raw)]] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[name] = have
        if size > 8 * BLOCK_BYTES:  # a very long text: don't keep its tables
            _powers.pop(name)
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial in the bytes, by prefix sums."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n + 1)[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power("down", _BASE_INV, n + 1)[starts])


#: Bytes of words as a classifier sees them: letters of ASCII, and all longer characters.
LETTER_BYTES = np.zeros(256, dtype=bool)
LETTER_BYTES[65:91] = LETTER_BYTES[97:123] = LETTER_BYTES[128:] = True


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, rows: int) -> DataFrame:
    """(text, y) of about ``rows`` labelled documents outside the held fold, at most; all of them if they are fewer.

    The choice is by a hash of the id, so it doesn't depend on order or partitions. The chosen ids are
    bounded by ``rows`` and are broadcast; texts aren't shuffled.
    """
    known = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull() & (fold(labels["doc_id"], folds) != held_fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    if n > rows:
        known = known.where(stable_shuffle(F.lit(7), "doc_id") < F.lit(int(rows / n * (1 << 63))))
    return texts_of(docs).join(F.broadcast(known), "doc_id").select("text", "y")


def stable_shuffle(*cols: Column) -> Column:
    """A fixed pseudo-random order key, non-negative."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def ranked(df: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``) and, for each of ``sums``, ``before_<name>``:
    the sum over the rows ahead.

    A range shuffle sorts the rows, so a hot value of a leading column spreads over partitions;
    each partition counts from zero and the partitions' totals (one row each) are added on.
    ``order`` should tell rows apart; rows equal in it may swap between runs.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = staged(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    ahead = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    names = ["rank", *[f"before_{c}" for c in sums]]
    values = [F.lit(1).cast("long"), *[F.col(c) for c in sums]]
    totals = laid.groupBy("_part").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(values))])
    inner = laid.withColumns({f"_w{i}": F.coalesce(F.sum(v).over(ahead), F.lit(0)) for i, v in enumerate(values)})
    out = inner.join(bases, "_part")
    return out.select(*df.columns, *[(F.col(f"_w{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)])


def rank_in_class(df: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """``df`` with ``rank`` from 0 among the rows of equal ``key``, in an arbitrary but fixed order.

    Rows of a class are dealt into buckets of some ten thousand by a hash of ``order``, ranked in
    their bucket, and moved by what the buckets ahead hold, so a class with most of the rows is no
    single task.
    """
    buckets = max(1, min(rows // 200, 512), rows // 20_000)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    here = Window.partitionBy(key, "_bucket").orderBy(*order)
    counts = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    return (
        dealt.withColumn("_r", F.row_number().over(here) - 1)
        .join(bases, [key, "_bucket"])
        .select(*df.columns, (F.col("_base") + F.col("_r")).cast("long").alias("rank"))
    )
