"""Independent claims about a change: windows, merging, disputes and agreement.

A claim set says of units what kind of change they saw; it may be unavailable as a whole, which is
no dissent. ``observed`` and ``absent`` are statements about one unit, ``unavailable`` about the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import f1, ratio


def in_window(on: Column, after: Column, until: Column) -> Column:
    """(after, until], where a null lower end is open and a null date is never inside."""
    return on.isNotNull() & (on <= until) & (after.isNull() | (on > after))


def merged(diff: DataFrame, claims: DataFrame, available: DataFrame, by: str = "act", unit: str = "unit") -> DataFrame:
    """Diff and claim by unit: ``status`` of each side, ``diff_kind``, ``claimed_kind``.

    Units that only the claims name are appended without text. ``diff`` is (act, unit, diff_kind),
    ``claims`` (act, unit, claimed_kind) with one row a unit, ``available`` the acts with any claim.
    """
    both = diff.join(claims, [by, unit], "full_outer")
    has = available.select(by).distinct().withColumn("_has", F.lit(True))
    out = both.join(has, by, "left")
    claim_status = F.when(F.col("claimed_kind").isNotNull(), F.lit("observed")).when(F.col("_has"), F.lit("absent")).otherwise(F.lit("unavailable"))
    diff_status = F.when(F.col("diff_kind").isNotNull(), F.lit("observed")).otherwise(F.lit("absent"))
    return out.withColumns({"diff_status": diff_status, "claim_status": claim_status, "textless": F.col("diff_kind").isNull()}).drop("_has")


def disputed(rows: DataFrame) -> DataFrame:
    """``disputed`` and its ``reason``: a side that sees nothing, or kinds that don't meet; presence comes first."""
    presence = F.array_contains(F.array("diff_status", "claim_status"), "absent") & F.array_contains(F.array("diff_status", "claim_status"), "observed")
    kinds = F.col("diff_kind").isNotNull() & F.col("claimed_kind").isNotNull() & (F.col("diff_kind") != F.col("claimed_kind"))
    reason = (
        F.when(presence & F.col("textless"), F.lit("textless"))
        .when(presence, F.lit("silent"))
        .when(kinds, F.lit("kind"))
    )
    return rows.withColumns({"disputed": presence | kinds, "reason": reason})


def explainable(change: Column, old: Column, new: Column, limit: int) -> Column:
    """Whether a change can be explained: it has a text, and if it was amended, what is shown of both sides (``limit`` characters) differs."""
    textless = old.isNull() & new.isNull()
    alike = (change == "modified") & (F.substring(old, 1, limit) == F.substring(new, 1, limit))
    return ~textless & ~F.coalesce(alike, F.lit(False))


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """Of observed units: shared, precision, recall, F1 and kind mismatches; an empty side counts as 1."""
    left, right = F.col("diff_status") == "observed", F.col("claim_status") == "observed"
    sums = rows.groupBy(*by).agg(
        F.count_if(left).alias("n_diff"), F.count_if(right).alias("n_claimed"), F.count_if(left & right).alias("n_shared"),
        F.count_if(left & right & (F.col("diff_kind") != F.col("claimed_kind"))).alias("n_kind_mismatch"),
    )
    precision, recall = ratio(F.col("n_shared"), F.col("n_diff")), ratio(F.col("n_shared"), F.col("n_claimed"))
    out = sums.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """How often each kind of one side meets each of the other; nothing is NONE."""
    return rows.groupBy(*by, F.coalesce("diff_kind", F.lit("NONE")).alias("diff_label"), F.coalesce("claimed_kind", F.lit("NONE")).alias("claim_label")).agg(F.count("*").alias("n"))


def pooled(cases: DataFrame) -> DataFrame:
    """Micro figures from summed counts, macro F1 as the mean over cases, in one row."""
    sums = cases.agg(
        F.coalesce(F.sum("n_diff"), F.lit(0)).alias("n_diff"), F.coalesce(F.sum("n_claimed"), F.lit(0)).alias("n_claimed"),
        F.coalesce(F.sum("n_shared"), F.lit(0)).alias("n_shared"), F.avg("f1").alias("macro_f1"),
    )
    out = sums.withColumns({"micro_precision": ratio(F.col("n_shared"), F.col("n_diff")), "micro_recall": ratio(F.col("n_shared"), F.col("n_claimed"))})
    return out.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall")))


def breaches(metrics: DataFrame, floors: dict[str, float], tolerance: float) -> DataFrame:
    """(metric, value, floor, breached): metrics that fall short of their floor by more than the tolerance."""
    stacked = metrics.select(F.expr(f"stack({len(floors)}, {', '.join(f"'{m}', {m}" for m in floors)}) AS (metric, value)"))
    floor = F.lit(None).cast("double")
    for metric, least in floors.items():
        floor = F.when(F.col("metric") == metric, F.lit(least)).otherwise(floor)
    return stacked.withColumn("floor", floor).withColumn("breached", F.col("value") < F.col("floor") - F.lit(tolerance))
