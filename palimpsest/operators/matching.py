"""Matching changes to watched places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_path

#: Reasons of a match, best first.
RANK = ("at", "inside", "container", "act")


def match(changes: DataFrame, items: DataFrame, act: str = "act") -> DataFrame:
    """(change columns, watchlist, reason, rank): one row for each change and watchlist, the best reason.

    ``items`` has ``watchlist, act, path`` (null: the whole act), ``changes`` has ``act, location``.
    The join is on the act; the path rule is a filter within it.
    """
    path, location = F.col("path"), F.col("location")
    reason = (
        F.when(path.isNull(), F.lit("act"))
        .when(location == path, F.lit("at"))
        .when(contains_path(path, location), F.lit("inside"))
        .when(contains_path(location, path), F.lit("container"))
    )
    hits = changes.join(items, act).withColumn("reason", reason).where("reason IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("reason")) - 1
    return hits.withColumn("rank", rank)


def best_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The hit with the least rank for each of ``keys``; of equal ranks the first path."""
    order = F.struct("rank", F.coalesce("path", F.lit("")))
    return hits.groupBy(*keys).agg(F.min_by(F.struct("reason", "rank"), order).alias("best")).select(*keys, "best.reason", "best.rank")
