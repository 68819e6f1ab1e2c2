"""The structural delta between two versions of a set of documents.

A version is a DataFrame ``act, location, pos, text`` with one row per unit: ``location`` is unique
within an act and version, ``pos`` is document order. Only digests and lengths are joined and
shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparison_text, digest

#: Version columns that a delta needs.
KEY = ("act", "location")


def prepared(version: DataFrame) -> DataFrame:
    """``act, location, pos, digest, verbatim, n_chars``; of repeated locations the last in order stays."""
    compared = comparison_text(F.col("text"))
    side = version.select("act", "location", "pos", digest(compared).alias("digest"), F.md5(F.col("text").cast("binary")).alias("verbatim"), F.char_length(compared).alias("n_chars"))
    value = F.struct("pos", "digest", "verbatim", "n_chars")
    return side.groupBy(*KEY).agg(F.max_by(value, "pos").alias("v")).select(*KEY, "v.*")


def diff_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every unit of either version: ``change_type`` and whether only its white space moved."""
    old, new = prepared(before), prepared(after)
    old = old.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("pos", "digest", "verbatim", "n_chars")])
    new = new.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("pos", "digest", "verbatim", "n_chars")])
    both = old.join(new, list(KEY), "full_outer")
    same = F.col("old_digest").eqNullSafe(F.col("new_digest"))
    kind = (
        F.when(F.col("old_pos").isNull(), F.lit("inserted"))
        .when(F.col("new_pos").isNull(), F.lit("deleted"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("modified"))
    )
    moved = (kind == "unchanged") & ~F.col("old_verbatim").eqNullSafe(F.col("new_verbatim"))
    return both.withColumns({"change_type": kind, "whitespace_only": moved})


def renumberings(delta: DataFrame) -> DataFrame:
    """``act, old_location, new_location``: deleted and inserted units of one text, the k-th with the k-th in order."""

    def side(kind: str, pos: str, text: str, name: str) -> DataFrame:
        order = Window.partitionBy("act", "digest").orderBy(pos)
        rows = delta.where(F.col("change_type") == kind).select("act", F.col("location").alias(name), F.col(text).alias("digest"), pos)
        return rows.where("digest IS NOT NULL").withColumn("k", F.row_number().over(order)).drop(pos)

    gone = side("deleted", "old_pos", "old_digest", "old_location")
    come = side("inserted", "new_pos", "new_digest", "new_location")
    return gone.join(come, ["act", "digest", "k"]).select("act", "old_location", "new_location")


def with_renumbered(delta: DataFrame) -> DataFrame:
    """The delta with each renumbered pair as one row ``renumbered`` at the new location."""
    pairs = renumberings(delta)
    moved = pairs.join(delta.select("act", F.col("location").alias("old_location"), F.col("old_pos").alias("p")), ["act", "old_location"])
    out = delta.join(pairs.select("act", F.col("old_location").alias("location")), ["act", "location"], "left_anti")
    out = out.join(moved.select("act", F.col("new_location").alias("location"), "old_location", "p"), ["act", "location"], "left")
    return out.withColumns(
        {
            "change_type": F.when(F.col("old_location").isNotNull(), F.lit("renumbered")).otherwise(F.col("change_type")),
            "old_pos": F.coalesce("old_pos", "p"),
        }
    ).drop("p")


def summary(delta: DataFrame, *by: str) -> DataFrame:
    """Counts of each change type and of touched units."""
    kind = F.col("change_type")
    counts = [F.count_if(kind == k).alias(f"n_{k}") for k in ("inserted", "deleted", "modified", "renumbered", "unchanged")]
    return delta.groupBy(*by).agg(*counts, F.count_if(kind != "unchanged").alias("n_touched"))


def emission_order(delta: DataFrame) -> DataFrame:
    """``ord`` per act: units in new order, each deletion behind the last unit before it that is still there.

    A deletion's slot is one more than the new place of that unit, or 0; at a slot, deletions come first.
    """
    survives = Window.partitionBy("act").orderBy("old_pos").rowsBetween(Window.unboundedPreceding, -1)
    new_order = Window.partitionBy("act").orderBy("new_pos")
    placed = delta.where("new_pos IS NOT NULL").withColumn("slot", (F.row_number().over(new_order) - 1).cast("long"))
    placed = placed.unionByName(delta.where("new_pos IS NULL").withColumn("slot", F.lit(None).cast("long")))
    had = placed.where("old_pos IS NOT NULL").withColumn("before", F.last("slot", ignorenulls=True).over(survives))
    fresh = placed.where("old_pos IS NULL").withColumn("before", F.lit(None).cast("long"))
    anchored = had.unionByName(fresh).withColumn("anchor", F.coalesce("slot", F.col("before") + 1, F.lit(0).cast("long")))
    order = Window.partitionBy("act").orderBy("anchor", F.col("slot").isNotNull().cast("int"), "old_pos", "location")
    return anchored.withColumn("ord", F.row_number().over(order)).drop("before", "slot")


def digest_pools(nodes: DataFrame) -> DataFrame:
    """Distinct comparison texts: how many nodes share each, and the first that has it."""
    side = nodes.select("location", digest(comparison_text(F.col("text"))).alias("digest"))
    return side.groupBy("digest").agg(F.count("*").alias("n_nodes"), F.min("location").alias("first_location"))


def changed_since(stored: DataFrame, listed: DataFrame, key: str = "key", sha: str = "sha") -> DataFrame:
    """What an incremental load does with each key: ``added``, ``rewritten``, ``kept`` or ``removed``."""
    old, new = stored.select(key, F.col(sha).alias("old_sha")), listed.select(key, F.col(sha).alias("new_sha"))
    both = old.join(new, key, "full_outer")
    action = (
        F.when(F.col("old_sha").isNull(), F.lit("added"))
        .when(F.col("new_sha").isNull(), F.lit("removed"))
        .when(F.col("old_sha") == F.col("new_sha"), F.lit("kept"))
        .otherwise(F.lit("rewritten"))
    )
    return both.select(key, action.alias("action"))
