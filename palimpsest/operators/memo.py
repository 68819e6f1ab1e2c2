"""A store of results by content: a pair of texts is compared once for each version of the rule that compares it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest
from ..sources import snapshots
from .stages import staged


def key_of(rule: str, *texts: Column) -> Column:
    """The key of texts under a rule: each by its own digest, so no two splits of one text share a key; a null has one of its own."""
    return F.sha2(F.concat_ws("|", F.lit(rule), *[F.coalesce(digest(t), F.lit("null")) for t in texts]).cast("binary"), 256)


def refreshed(spark: SparkSession, base: str, pairs: DataFrame, rule: str, compute: Callable[[DataFrame], DataFrame], name: str = "comparisons") -> tuple[DataFrame, int, int]:
    """(store, computed, reused) for ``pairs`` (before, after): what the store at ``base`` lacks is computed and added as one part.

    ``compute`` gets (key, before, after) of each missing pair once and returns (key, ...). A second run over the same pairs
    computes nothing and publishes nothing; another version of the rule has keys of its own. If two runs add at once, one of them
    gets a :class:`~palimpsest.sources.snapshots.Conflict` and may run again.
    """
    keyed = pairs.select(key_of(rule, F.col("before"), F.col("after")).alias("key"), "before", "after")
    keys = staged(keyed.select("key").distinct())
    number, tables = snapshots.current(spark, base)
    missing = keys.join(snapshots.read(spark, base, name, number).select("key"), "key", "left_anti") if name in tables else keys
    missing = staged(missing)
    wanted, computed = keys.count(), missing.count()
    if computed:
        # texts move only for what is computed, one of each
        texts = keyed.join(missing, "key", "left_semi").groupBy("key").agg(F.first(F.struct("before", "after")).alias("t"))
        snapshots.publish(spark, base, appended={name: compute(texts.select("key", "t.*"))}, after=number)
    store = snapshots.read(spark, base, name) if wanted or name in tables else compute(keyed.limit(0))
    return store, computed, wanted - computed
