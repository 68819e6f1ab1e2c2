"""The notification poll as a stream: entries once, then the first entry of each resolved key.

A file source feeds the stream, every entry passes once within the horizon, and each micro-batch is
merged into a keyed state table by the same rules as the batch form. The state lives in versions
under the poll's folder; a batch that is run again writes its version again, so a replay changes
nothing, and a poll that is started again goes on from its newest version.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How long a repeated entry is known as such, and for how many days a resolved key is kept.
ENTRY_HORIZON = "60 days"
KEY_DAYS = 365

STATE = "user_id long, event_type string, event_id long, n_entries long, seen timestamp"


def _shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or pass a folder")
        where = "file://" + tempfile.mkdtemp(prefix="palimpsest-")  # local mode: driver and executors are one
    return f"{where.rstrip('/')}/poll-{uuid.uuid4().hex}"


def deduplicated(entries: DataFrame, entry: str = "event_id", at: str = "ts", horizon: str = ENTRY_HORIZON) -> DataFrame:
    """Each entry once within the horizon of event time; works on streams and tables."""
    if not entries.isStreaming:
        return entries.dropDuplicates([entry])
    return entries.withWatermark(at, horizon).dropDuplicatesWithinWatermark([entry])


def advanced(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The keyed state with a batch of new entries: the first entry of each key, how many came, and the last time.

    A key not seen for ``KEY_DAYS`` before the newest entry is let go.
    """
    new = batch.select("user_id", "event_type", "event_id", F.lit(1).cast("long").alias("n_entries"), F.col("ts").cast("timestamp").alias("seen"))
    both = state.unionByName(new)
    newest = both.agg(F.max("seen").alias("newest"))  # one row
    kept = both.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.sum("n_entries").alias("n_entries"), F.max("seen").alias("seen"))
    return kept.join(newest, F.col("seen") >= F.col("newest") - F.expr(f"INTERVAL {KEY_DAYS} DAYS")).drop("newest")


def state_before(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The newest state of a poll's folder, before batch ``number`` if given; empty if there is none."""
    try:
        states = spark.read.schema(STATE + ", batch long").parquet(f"{base}/state")
    except AnalysisException:  # no batch has been written
        return spark.createDataFrame([], STATE)
    last = (states if number is None else states.where(F.col("batch") < number)).agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == last).drop("batch") if last is not None else spark.createDataFrame([], STATE)


def polled(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Runs the stream over the files of ``path`` that are new and returns the state after the last batch.

    ``base`` is the poll's folder: with it, a later call goes on where the last one ended.
    """
    base = base or _shared(spark)
    source = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    feed = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    entries = feed.parquet(path) if not name.endswith(".parquet") or _is_folder(spark, path) else feed.option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        advanced(state_before(spark, base, number), batch).write.mode("overwrite").parquet(f"{base}/state/batch={number}")

    run = deduplicated(entries.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")).writeStream.foreachBatch(merge)
    run.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state_before(spark, base)


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    return bool(files) and not files[0].path.endswith(path.rsplit("/", 1)[-1])
