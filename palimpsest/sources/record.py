"""The change record, text store and feeds as sources and sinks: JSON with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One change event: a JSON document for an act and the version it leads to.
EVENT_SCHEMA = """schema_version string, corpus string, act_key string, from_version string, to_version string, detected_on date,
in_force array<date>, changes array<struct<location:string,change_type:string,before:string,after:string,in_force:date,
signals:array<struct<name:string,status:string,change_types:array<string>>>,
table_entries:array<struct<container:string,table:int,key:string,occurrence:int,kind:string,typography_only:boolean>>>>"""

#: One stored version: its nodes in document order.
STORE_SCHEMA = "schema_version string, corpus string, act_key string, version string, nodes array<struct<location:string,parent:string,heading:string,text:string>>"

KNOWN_VERSIONS = ("1.0", "1.1", "1.2", "1.3")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events below ``path``; a document that doesn't fit the schema is an error."""
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def event_changes(events: DataFrame) -> DataFrame:
    """One row per change with its event's key, its place and its occurrence at its location."""
    key = F.concat_ws("@", F.concat_ws("/", "corpus", "act_key"), "to_version")
    each = events.select(key.alias("event_key"), "corpus", "act_key", "from_version", "to_version", "detected_on", F.posexplode("changes").alias("ord", "c"))
    from pyspark.sql import Window

    w = Window.partitionBy("event_key", "c.location").orderBy("ord")
    return each.select("event_key", "corpus", "act_key", "from_version", "to_version", "detected_on", "ord", "c.*", F.row_number().over(w).alias("occurrence"))


def write_events(events: DataFrame, path: str) -> None:
    """A folder for each event, by corpus, act and version; an event that is written again is replaced, others stay."""
    keys = {f"of_{c}": F.col(c) for c in ("corpus", "act_key", "to_version")}  # the documents keep their own fields
    events.withColumns(keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored versions with ``state``: ``read``, or why not; an unknown schema is set aside, never guessed at."""
    rows = spark.read.schema(STORE_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    state = F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable")).when(~F.coalesce(F.col("schema_version").isin(*KNOWN_VERSIONS), F.lit(False)), F.lit("unknown schema")).otherwise(F.lit("read"))
    return rows.withColumn("state", state).drop("_corrupt")


def store_nodes(store: DataFrame) -> DataFrame:
    """(corpus, act_key, version, pos, location, parent, heading, text) of the versions that were read."""
    return store.where("state = 'read'").select("corpus", "act_key", "version", F.posexplode("nodes").alias("pos", "n")).select("corpus", "act_key", "version", "pos", "n.*")


def upserted(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with equal keys."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted_once(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys ``current`` doesn't have, once each."""
    return new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


#: One page of a notification feed.
FEED_ROW = "entry STRUCT<id: STRING, updated: TIMESTAMP, identifier: ARRAY<STRING>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, updated, scheme, value) of the entries of XML feed pages; identifiers are percent-decoded."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("id string, updated timestamp, identifier array<string>").load(path)
    each = rows.select(F.col("id").alias("entry_id"), "updated", F.explode_outer("identifier").alias("i"))
    return each.select("entry_id", "updated", F.split_part("i", F.lit(":"), F.lit(1)).alias("scheme"), F.url_decode(F.expr("substr(i, instr(i, ':') + 1)")).alias("value"))
