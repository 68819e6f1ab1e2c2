"""Ordering effects: occurrences, consecutive versions, supersession, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "occurrence", start: int = 1) -> DataFrame:
    """The place of each row among those of its keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, (place + (start - 1)).cast("long"))


def consecutive(versions: DataFrame, act: str, version: str, order: list[str], readable: Column) -> DataFrame:
    """``act, from_version, to_version, bridged``: neighbours among the readable versions, and how many lie between."""
    place = Window.partitionBy(act).orderBy(*order)
    seen = versions.withColumn("_n", F.row_number().over(place)).where(readable)
    pairs = seen.select(act, F.lag(version).over(place).alias("from_version"), F.col(version).alias("to_version"), (F.col("_n") - F.lag("_n").over(place) - 1).cast("long").alias("bridged"))
    return pairs.where("from_version IS NOT NULL")


def newest_first(rows: DataFrame, keys: list[str], recency: list[Column]) -> DataFrame:
    """Of the rows of equal keys, the newest, by ``recency`` descending."""
    order = Window.partitionBy(*keys).orderBy(*[c.desc() for c in recency])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def superseded(mentions: DataFrame, keys: list[str], recency: list[str], value: str) -> DataFrame:
    """Each mention with the newest value of its keys and whether that supersedes its own."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in recency]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = F.first_value(value).over(w)
    return mentions.withColumn("newest", newest).withColumn("superseded", ~F.col(value).eqNullSafe(F.col("newest")))


def evenly_spaced(rows: DataFrame, by: str, order: list[str], wanted: int) -> DataFrame:
    """At most ``wanted`` rows of each group, evenly spaced in order, both ends included; halves go to the even place."""
    w = Window.partitionBy(by)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    steps = F.sequence(F.lit(0), F.least(F.lit(wanted), F.col("_n").cast("int")) - 1)
    k = F.least(F.lit(wanted), F.col("_n").cast("int"))
    at = F.when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_distinct(F.transform(steps, lambda j: F.rint(j * (F.col("_n") - 1) / (k - 1)).cast("long")))
    )
    chosen = sizes.select(by, F.explode(at).alias("_i"))
    return placed.drop("_n").join(chosen, [by, "_i"], "left_semi").drop("_i")


def trailing_count(rows: DataFrame, key: str, seconds_col: str, window_seconds: int) -> DataFrame:
    """For each row, how many of its key lie in (t - window, t]."""
    w = Window.partitionBy(key).orderBy(seconds_col).rangeBetween(-window_seconds + 1, 0)
    return rows.withColumn("n_recent", F.count("*").over(w))
