"""Dates in texts and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _built(digits: Column) -> Column:
    return F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date")


def iso(raw: Column) -> Column:
    """A date written ``2026-07-27`` or ``2007/11/23``; null if unreadable."""
    t = F.trim(raw)
    return F.when(F.replace(t, F.lit("/"), F.lit("-")).rlike(r"^\d{4}-\d{2}-\d{2}$"), _built(F.regexp_replace(t, "[-/]", "")))


def compact(raw: Column) -> Column:
    """A date written ``20271202``, as attributes of the markup have it; null if unreadable."""
    t = F.trim(raw)
    return F.when(t.rlike(r"^\d{8}$"), _built(t))


def mentions(text: Column) -> Column:
    """The ISO dates of a text, readable or not, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))


def window_start(flag: Column, cursor: Column, end: Column) -> Column:
    """Where a poll starts: as told, else an hour before the cursor, else 14 days before the end."""
    return F.coalesce(flag, cursor - F.expr("INTERVAL 1 HOUR"), end - F.expr("INTERVAL 14 DAYS"))


def effect_date(stated: Column, deferred: Column, default: Column) -> Column:
    """struct<day,tier>: the first of a clause's own date, its deferral and the document's default."""
    tier = F.when(stated.isNotNull(), F.lit("stated")).when(deferred.isNotNull(), F.lit("deferred")).when(default.isNotNull(), F.lit("default"))
    return F.struct(F.coalesce(stated, deferred, default).alias("day"), F.coalesce(tier, F.lit("none")).alias("tier"))
