"""Notifications: two layers of dedupe, pending rows, digest periods (batch forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduped(feed: DataFrame, entry: str, keys: list[str], order: list[str]) -> DataFrame:
    """First each entry once, then of entries with equal ``keys`` the first, with how many it stands for."""
    once = feed.groupBy(entry).agg(F.min_by(F.struct(*[c for c in feed.columns if c != entry]), F.struct(*order)).alias("v")).select(entry, "v.*")
    first = F.min_by(F.struct(entry, *[c for c in order if c not in (entry, *keys)]), F.struct(*order, entry))
    return once.groupBy(*keys).agg(first.alias("v"), F.count("*").alias("n_entries")).select(*keys, "v.*", "n_entries")


def pending(old: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """The pending rows after a poll on day ``on``: kept rows keep first_seen and count the day, new rows begin.

    ``old`` has key, first_seen, last_checked, checks; ``seen`` has key, resolved. Resolved keys go.
    """
    day = F.to_date(F.lit(on))
    both = old.join(seen.groupBy("key").agg(F.bool_or("resolved").alias("resolved")), "key", "full_outer").where(~F.coalesce("resolved", F.lit(False)))
    again = F.col("resolved").isNotNull() & ~F.col("last_checked").eqNullSafe(day)
    return both.select(
        "key", F.coalesce("first_seen", day).alias("first_seen"), F.when(F.col("resolved").isNotNull(), day).otherwise(F.col("last_checked")).alias("last_checked"),
        (F.coalesce("checks", F.lit(0)) + again.cast("int")).cast("int").alias("checks"),
    )


def digest_periods(rows: DataFrame, at: str, by: str) -> DataFrame:
    """Counts per ``by`` and period: days, and weeks that begin on Monday."""
    day, week = F.to_date(F.date_trunc("day", at)), F.to_date(F.date_trunc("week", at))
    periods = F.array(F.struct(F.lit("daily").alias("kind"), day.alias("begins")), F.struct(F.lit("weekly").alias("kind"), week.alias("begins")))
    return rows.select(by, F.explode(periods).alias("p")).groupBy(by, "p.kind", "p.begins").agg(F.count("*").alias("n"))
