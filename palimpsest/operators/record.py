"""The change record: indexes, history, latest, search, incremental counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_counts(changes: DataFrame, by: str, unit: str, deferred: Column, textless: Column) -> DataFrame:
    """Per ``by``: units whose changes are all date moves, else all textless, else substantive."""
    units = changes.groupBy(by, unit).agg(F.bool_and(deferred).alias("d"), F.bool_and(textless).alias("t"))
    return units.groupBy(by).agg(
        F.count_if("d").alias("n_date_only"), F.count_if(~F.col("d") & F.col("t")).alias("n_textless"), F.count_if(~F.col("d") & ~F.col("t")).alias("n_substantive")
    )


def act_index(changes: DataFrame, act: str, unit: str, recency: list[Column], keep: list[str]) -> DataFrame:
    """Rows of each unit of an act, newest first: ``place`` and how many the unit has."""
    w = Window.partitionBy(act, unit)
    return changes.select(act, unit, *keep, F.row_number().over(w.orderBy(*[c.desc() for c in recency])).cast("long").alias("place"), F.count("*").over(w).alias("n_of_unit"))


def root_index(changes: DataFrame, act: str, event: str, unit: str, on: str) -> DataFrame:
    """One row per act: events, changes, units, first and last date, newest event."""
    return changes.groupBy(act).agg(
        F.count_distinct(event).alias("n_events"), F.count("*").alias("n_changes"), F.count_distinct(unit).alias("n_units"),
        F.min(on).alias("first_on"), F.max(on).alias("last_on"), F.max(F.struct(on, event))[event].alias("newest_event"),
    )


def history(changes: DataFrame, unit: str, recency: list[Column], value: str) -> DataFrame:
    """Every step of a unit, newest first, with the value of the step before it in time."""
    newest = Window.partitionBy(unit).orderBy(*[c.desc() for c in recency])
    return changes.withColumns({"step": F.row_number().over(newest).cast("long"), f"previous_{value}": F.lead(value).over(newest)})


def since(changes: DataFrame, on: Column, after: str, order: list[Column], limit: int, most: int = 500) -> DataFrame:
    """The first ``limit`` changes whose date is ``after`` or later, and how many the limit leaves out.

    The limit is the feature, clamped to [1, ``most``]; a null date is never since anything.
    """
    n = max(1, min(limit, most))
    found = changes.where(on >= F.to_date(F.lit(after)))
    omitted = max(0, found.count() - n)
    return found.orderBy(*order).limit(n).withColumn("n_omitted", F.lit(omitted).cast("long"))


def latest_per(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("v")).select(key, "v.*")


def zero_filled(counts: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Counts for every code of a small dimension, zero where nothing has it."""
    return codes.join(counts, code, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def eligibility(rows: DataFrame, detected: str, in_force: str, live_since: str, bootstrap: Column, fresh_days: int = 60) -> DataFrame:
    """Ordered rules: bootstrap, before_live, stale (detected more than ``fresh_days`` after coming into force), fresh."""
    stale = F.datediff(F.col(detected), F.col(in_force)) > fresh_days
    judged = (
        F.when(bootstrap, F.lit("bootstrap"))
        .when(F.col(detected) < F.to_date(F.lit(live_since)), F.lit("before_live"))
        .when(stale, F.lit("stale"))
        .otherwise(F.lit("fresh"))
    )
    return rows.withColumn("judgement", judged)


def inverted(rows: DataFrame, identifier: str, holder: str) -> DataFrame:
    """identifier -> distinct holders, and how many rows name it."""
    return rows.groupBy(identifier).agg(F.count_distinct(holder).alias("n_holders"), F.count("*").alias("n_rows"), F.min(holder).alias("first_holder"))
