"""Queries on the notification feed: events stand for notifications, users for acts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing, watch
from ..streaming import poll
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def digest_periods(spark, sf_dir):
    return watch.digest_periods(table(spark, sf_dir, "events"), "ts", "event_type")


def feed_dedupe_two_layer(spark, sf_dir):
    feed = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return watch.deduped(feed, "event_id", ["user_id", "event_type"], ["ts"]).select("user_id", "event_type", "event_id", "ts", "n_entries")


def trailing_event_count(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return pairing.trailing_count(rows, "user_id", "second", 3600).select("event_id", "user_id", "n_recent")


def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("n_missing"))


def streaming_poll(spark, sf_dir):
    return poll.polled(spark, f"{sf_dir}/events.parquet").drop("seen")


QUERIES |= {f.__name__: f for f in (digest_periods, feed_dedupe_two_layer, trailing_event_count, json_props, streaming_poll)}
ORACLE |= {
    "digest_periods": """SELECT event_type, 'daily' AS kind, date_trunc('day', ts)::DATE AS begins, count(*) AS n FROM events GROUP BY 1, 3
UNION ALL SELECT event_type, 'weekly', date_trunc('week', ts)::DATE, count(*) FROM events GROUP BY 1, 3""",
    "feed_dedupe_two_layer": """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, count(DISTINCT event_id) AS n_entries FROM events GROUP BY 1, 2""",
    "trailing_event_count": """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n_recent FROM events""",
    "json_props": """SELECT event_type, count(k) AS n_k, sum(k)::BIGINT AS sum_k, max(k) AS max_k, count(*) FILTER (json_extract(props, '$.none') IS NULL) AS n_missing
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
    "streaming_poll": """SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n_entries FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2""",
}
