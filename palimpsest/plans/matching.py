"""Queries that match changes to watched places; a nation is a watchlist over its customers' acts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _items(spark, sf_dir):
    key = F.col("c_custkey")
    path = F.when(key % 3 == 1, F.lit("LN 1")).when(key % 3 == 2, F.lit("LN 2 PT 7 SU 1"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("watchlist"), key.alias("act"), path.alias("path"))


def _hits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("act"))
    number, part = F.col("l_linenumber"), F.col("l_partkey") % 10
    location = F.when(number % 3 == 0, F.concat_ws(" ", F.lit("LN"), number)).otherwise(F.concat_ws(" ", F.lit("LN"), number, F.lit("PT"), part))
    changes = table(spark, sf_dir, "lineitem").select("l_orderkey", location.alias("location")).distinct().join(orders, "l_orderkey")
    return matching.match(changes, _items(spark, sf_dir))


_HITS = """items AS (SELECT c_nationkey AS watchlist, c_custkey AS act, CASE c_custkey % 3 WHEN 1 THEN 'LN 1' WHEN 2 THEN 'LN 2 PT 7 SU 1' END AS path FROM customer),
changes AS (SELECT DISTINCT l_orderkey, o_custkey AS act,
  CASE WHEN l_linenumber % 3 = 0 THEN 'LN ' || l_linenumber ELSE 'LN ' || l_linenumber || ' PT ' || (l_partkey % 10) END AS location FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT *, CASE WHEN path IS NULL THEN 'act' WHEN location = path THEN 'at' WHEN starts_with(location, path || ' ') THEN 'inside' WHEN starts_with(path, location || ' ') THEN 'container' END AS reason
  FROM changes JOIN items USING (act)),
hits AS (SELECT *, list_position(['at', 'inside', 'container', 'act'], reason) - 1 AS rank FROM h WHERE reason IS NOT NULL)"""


def watch_matching(spark, sf_dir):
    return _hits(spark, sf_dir).select("l_orderkey", "location", "watchlist", "reason").distinct()


def best_hit_rank(spark, sf_dir):
    return matching.best_hits(_hits(spark, sf_dir), ["l_orderkey", "watchlist"]).withColumn("rank", F.col("rank").cast("int"))


QUERIES |= {"watch_matching": watch_matching, "best_hit_rank": best_hit_rank}
ORACLE |= {
    "watch_matching": f"WITH {_HITS} SELECT DISTINCT l_orderkey, location, watchlist, reason FROM hits",
    "best_hit_rank": f"WITH {_HITS} SELECT l_orderkey, watchlist, arg_min(reason, (rank, coalesce(path, ''))) AS reason, min(rank)::INT AS rank FROM hits GROUP BY 1, 2",
}
