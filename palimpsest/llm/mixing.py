"""Mixing sources to target weights by a low-discrepancy schedule (operator 2).

Sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a
target stops at ``MOST`` times its source's words and the excess is reshared by weight. The schedule
is a row of slots of ``BLOCK_WORDS`` words each. Slot i's point is the fraction of i times the golden
ratio, mapped through the sources' cumulative targets; the rank of a slot among those of its source
names the block it takes. A source's blocks are its documents in shuffled order, end to end, cut into
equal blocks, twice over; block k of a source joins its slot of rank k. The mix is what the slots hold,
in their order (:func:`scheduled`), so any stretch of it has the sources near their weights. A document's
``taken`` is what the joined blocks hold of it, at most ``MOST`` times its size, and ``first_slot`` the
first of them; the last block of a source is cut at its target. The schedule starts ``SLACK`` beyond the
number of slots needed and runs on until every source has its own; slots that a source doesn't need are
void.

Defined results: null text has size 0 and takes nothing; null sources are one source; repeated rows
are mixed each on their own; a null id is shuffled like any other; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ranked, staged, table, text_blocks, word_spans

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SLACK = 0.02
#: Cells that the points' range is cut into, to look a point's source up by an equal join.
CELLS = 4096
#: Slots in a chunk: ranks are counted by chunk and carried over from chunk to chunk.
CHUNK = 1 << 16
GOLDEN = 0.6180339887498949
SEED = 20_25


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size)."""
    narrow = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                size[lo:hi] = np.bincount(word_spans(raw, offs)[2], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size)], names=["doc_id", "source", "size"])

    return narrow.mapInArrow(run, "doc_id long, source string, size long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, weight, target): sid is the source's place by code point.

    Resharing the excess ends where every source has its weight's share at one common rate, or
    ``MOST`` times its words if that is less; each round raises the rate by what the sources at their
    stop leave over, and reads three sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    by_place = ranked(totals, ["last", "source"]).withColumnRenamed("rank", "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    weighed = staged(by_place.select("source", "sid", "source_size", weight.alias("weight")))
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped, stop = 0.0, -1, MOST * F.col("source_size")
    while whole:
        at_stop = stop < rate * F.col("weight")
        n, held, free = weighed.agg(
            F.count(F.when(at_stop, 1)), F.sum(F.when(at_stop, stop).otherwise(0)), F.sum(F.when(at_stop, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == stopped or not free:
            break
        rate, stopped = (SHARE * whole - held) / free, n
    return weighed.withColumn("target", F.least(stop.cast("double"), F.lit(rate) * F.col("weight")))


def point(slot: Column) -> Column:
    """The fraction of slot times the golden ratio; high and low bits apart keep it exact to 2**-32."""
    high, low = F.shiftright(slot, 20), slot.bitwiseAND(F.lit((1 << 20) - 1))
    return (high * F.lit((1 << 20) * GOLDEN % 1) % 1 + low * F.lit(GOLDEN) % 1) % 1


def schedule(wanted: DataFrame) -> DataFrame:
    """(sid, block, slot): the slots, each with its source and its rank among that source's slots.

    Points are mapped by the slots that each source needs, and run on until each has them: any span of
    the points' range is met in the end, so the rounds end.
    """
    spark = wanted.sparkSession
    need = F.ceil(last_word() / BLOCK_WORDS).cast("long")
    spans = staged(ranked(wanted.select("sid", need.alias("need")).where("need > 0"), ["sid"], ("need",)))
    needed = spans.agg(F.sum("need")).first()[0] or 0
    spans = spans.select("sid", "need", (F.col("before_need") / needed).alias("lo"), ((F.col("before_need") + F.col("need")) / needed).alias("hi"))
    cells = staged(spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS)))))
    slots = int(needed * (1 + SLACK)) + 64
    while True:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots // (1 << 22))
        drawn = spark.range(0, slots, 1, parts).select("id", point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
        hit = drawn.join(cells, "cell").where("lo <= u AND u < hi").select("sid", "id", F.shiftright("id", 16).alias("chunk"))
        served = hit.groupBy("sid").agg(F.count("*").alias("n"))
        if spans.join(served, "sid", "left").where("coalesce(n, 0) < need").isEmpty():
            break
        slots += slots // 2
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    here = Window.partitionBy("sid", "chunk").orderBy("id")
    return hit.withColumn("r", F.row_number().over(here) - 1).join(bases, ["sid", "chunk"]).select("sid", (F.col("base") + F.col("r")).alias("block"), F.col("id").alias("slot"))


def last_word() -> Column:
    """Where a source's stream ends: its target, in whole words."""
    return F.least(F.floor(F.col("target") + 1e-6), MOST * F.col("source_size"))


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(rows with their place in their source's stream, targets, whether anything is wanted)."""
    sizes = staged(word_counts(docs, id_col, text_col, source_col))
    wanted = staged(targets(sizes))
    known = sizes.join(wanted, sizes.source.eqNullSafe(wanted.source)).select("doc_id", sizes.source, "size", "sid", "source_size", "target")
    shuffled = known.withColumn("key", F.xxhash64(F.lit(SEED), "doc_id"))
    laid = ranked(shuffled, ["sid", "key", "doc_id", "size"], ("size",)).withColumnRenamed("before_size", "at")
    first = laid.groupBy("sid").agg(F.min("at").alias("first_at"))
    return staged(laid.join(first, "sid").withColumn("start", F.col("at") - F.col("first_at"))), wanted, bool(wanted.agg(F.sum("target")).first()[0])


def _blocks(streamed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slot, sid, block, rank, doc_id, turn, words): what each slot holds of which row; turn 1 is a row's second time."""
    begins = F.posexplode(F.array(F.col("start"), F.col("start") + F.col("source_size"))).alias("turn", "begin")
    passes = streamed.where("size > 0").select("rank", "doc_id", "sid", "size", last_word().alias("end_at"), begins)
    passes = passes.withColumn("stop", F.least(F.col("begin") + F.col("size"), "end_at")).where("begin < stop")
    held = passes.withColumn("block", F.explode(F.expr(f"sequence(begin div {BLOCK_WORDS}, (stop - 1) div {BLOCK_WORDS})")))
    within = F.least("stop", (F.col("block") + 1) * BLOCK_WORDS) - F.greatest("begin", F.col("block") * BLOCK_WORDS)
    # blocks grow with the input, and their number is not told by the size of the rows that they come from: never a broadcast
    joined = held.withColumn("words", within).join(schedule(wanted).hint("merge"), ["sid", "block"])
    return joined.select("slot", "sid", "block", "rank", "doc_id", "turn", "words")


def scheduled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (slot, sid, block, doc_id, turn, words), to be read by slot; sid is the source's place by code point."""
    streamed, wanted, some = _streams(docs, id_col, text_col, source_col)
    blocks = _blocks(streamed, wanted) if some else docs.sparkSession.createDataFrame([], "slot long, sid long, block long, rank long, doc_id long, turn int, words long")
    return blocks.drop("rank")


def takes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, first_slot, and again_slot of its second time."""
    streamed, wanted, some = _streams(docs, id_col, text_col, source_col)
    head = ["doc_id", "source", "size", "source_size", "target"]
    if not some:
        return streamed.select(*head, F.lit(0).cast("long").alias("taken"), *[F.lit(None).cast("long").alias(c) for c in ("first_slot", "again_slot")])
    slot = [F.min(F.when(F.col("turn") == t, F.col("slot"))).alias(c) for t, c in enumerate(("first_slot", "again_slot"))]
    taken = _blocks(streamed, wanted).groupBy("rank").agg(F.sum("words").alias("taken"), *slot)
    return streamed.join(taken, "rank", "left").select(*head, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "again_slot")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, with every column of ``docs``, in the order of the schedule.

    A row stands as often as the mix takes its words, rounded, each time at the slot where that begins.
    Rows that share an id share their mean number of times.
    """
    took = takes(docs, id_col, text_col, source_col)
    times = took.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("z"), F.min("first_slot").alias("s0"), F.min("again_slot").alias("s1"))
    times = times.where("z > 0").withColumn("n", F.round(F.col("t") / F.col("z")).cast("int")).where("n > 0")
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # no column has such a name
    slots = F.slice(F.array(F.coalesce("s0", "s1"), F.coalesce("s1", "s0")), F.lit(1), F.col("n"))
    placed = times.select(F.col("doc_id").alias(f"id{mark}"), F.explode(slots).alias(f"slot{mark}"))
    out = docs.join(placed, docs[id_col].cast("long").eqNullSafe(placed[f"id{mark}"]))
    return out.repartitionByRange(f"slot{mark}").sortWithinPartitions(f"slot{mark}").select(*[docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return takes(table(spark, sf_dir, "documents")).drop("source")
