"""Set operations, upserts and incremental upkeep on keyed tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moved_values(before: Column, after: Column) -> tuple[Column, Column]:
    """(removed, added) of two array columns: distinct, sorted."""
    return F.array_sort(F.array_except(before, after)), F.array_sort(F.array_except(after, before))


def shift(before: DataFrame, after: DataFrame, by: str, unit: str) -> DataFrame:
    """Per ``by``: how many units were gained and dropped."""
    gone = before.select(by, unit).exceptAll(after.select(by, unit)).select(by, F.lit(-1).alias("_d"))
    come = after.select(by, unit).exceptAll(before.select(by, unit)).select(by, F.lit(1).alias("_d"))
    return gone.unionByName(come).groupBy(by).agg(F.count_if(F.col("_d") > 0).alias("n_gained"), F.count_if(F.col("_d") < 0).alias("n_dropped"))


def first_kept(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A union that keeps the first value of each key."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def overlaid(carried: DataFrame, written: DataFrame, key: str, value: str) -> DataFrame:
    """The values of both, where ``written`` wins."""
    new = written.select(key, F.col(value).alias("_new"))
    return carried.join(new, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def ledger(old: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """(key, status, tries): the newest status of each key, tries added up over replacements."""
    tried = attempts.select(key, F.col("status").alias("_status"), F.col("tries").alias("_tries"))
    both = old.join(tried, key, "full_outer")
    return both.select(key, F.coalesce("_status", "status").alias("status"), (F.coalesce("tries", F.lit(0)) + F.coalesce("_tries", F.lit(0))).alias("tries"))


def evidence(stated: DataFrame, derived: DataFrame, key: str, digest: str) -> DataFrame:
    """What becomes of each stated explanation: carried, reasked, added or withdrawn."""
    old, new = stated.select(key, F.col(digest).alias("_old")), derived.select(key, F.col(digest).alias("_new"))
    plan = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("withdrawn"))
        .when(F.col("_old") == F.col("_new"), F.lit("carried"))
        .otherwise(F.lit("reasked"))
    )
    return old.join(new, key, "full_outer").select(key, plan.alias("plan"))


def interleaved(base: DataFrame, extra: DataFrame, act: str, key: str, ord_col: str) -> DataFrame:
    """Extras with the place of the first base row of their act whose key is greater, else one past the last."""
    placed = base.select(act, F.col(key), F.col(ord_col).alias("_o"), F.lit(1).alias("_base"))
    both = placed.unionByName(extra.select(act, key).distinct().withColumns({"_o": F.lit(None).cast(dict(base.dtypes)[ord_col]), "_base": F.lit(0)}))
    # from the greatest key down, at one key extras first: what stands ahead has a greater key
    ahead = Window.partitionBy(act).orderBy(F.desc(key), "_base").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_at", F.min("_o").over(ahead)).where("_base = 0")
    last = base.groupBy(act).agg(F.max(ord_col).alias("_last"))
    return found.join(last, act, "left").select(act, key, F.coalesce("_at", F.col("_last") + 1, F.lit(1)).alias("place"))


def units_of(locations: DataFrame, units: DataFrame, location: str, unit: str) -> DataFrame:
    """Each location with the shortest of its word prefixes that is a unit, null if none is."""
    tokens = F.split(location, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))
    each = locations.select(location).distinct().select(location, F.explode(prefixes).alias(unit))
    hits = each.join(units.select(unit).distinct(), unit, "left_semi").groupBy(location).agg(F.min_by(unit, F.char_length(unit)).alias(unit))
    return locations.select(location).distinct().join(hits, location, "left")


def accepted(hits: DataFrame, key: str, second: str, limit: int, window: int) -> DataFrame:
    """Rate limiting: a hit is accepted if fewer than ``limit`` accepted hits of its key lie in the last ``window`` seconds.

    Each decision depends on those before it, so a key's hits are folded in order, batch by batch of a sorted partition: what
    is held is the last accepted times, ``limit`` at most, however many hits a caller has.
    """
    others = [c for c in hits.columns if c not in (key, second)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, kept = object(), deque()
        for rows in batches:
            out = []
            for who, t in zip(rows[key], rows[second]):
                who = None if pd.isna(who) else who  # hits without a caller are one caller's
                if who != caller:
                    caller, kept = who, deque()
                while kept and kept[0] <= t - window:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield rows.assign(accepted=out)

    schema = ", ".join(f"{c} {t}" for c, t in hits.dtypes) + ", accepted boolean"
    return hits.repartition(key).sortWithinPartitions(key, second, *others).mapInPandas(fold, schema)
