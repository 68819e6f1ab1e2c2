"""Queries on the change record; an order is an event of its customer's act, a line item a change."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.identifiers import cas_check, ec_check, index_check
from ..operators import pairing, record
from ..operators.stages import shared_dir
from ..sources import snapshots
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("on_date"))
    items = table(spark, sf_dir, "lineitem")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


_CHANGES = "changes AS (SELECT *, o_orderdate::DATE AS on_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    """WITH u AS (SELECT l_orderkey, l_partkey, bool_and(l_returnflag = 'N') AS d, bool_and(l_linestatus = 'O') AS t FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) FILTER (d) AS n_date_only, count(*) FILTER (NOT d AND t) AS n_textless, count(*) FILTER (NOT d AND NOT t) AS n_substantive FROM u GROUP BY 1"""
)
def entry_counts(spark, sf_dir):
    return record.unit_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.col("l_returnflag") == "N", F.col("l_linestatus") == "O")


@query(
    f"""WITH {_CHANGES} SELECT o_custkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice,
row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY on_date DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_suppkey DESC) AS place,
count(*) OVER (PARTITION BY o_custkey, l_partkey) AS n_of_unit FROM changes"""
)
def act_index(spark, sf_dir):
    recency = [F.col(c) for c in ("on_date", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")]
    return record.act_index(_changes(spark, sf_dir), "o_custkey", "l_partkey", recency, ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query(
    f"""WITH {_CHANGES} SELECT o_custkey, count(DISTINCT l_orderkey) AS n_events, count(*) AS n_changes, count(DISTINCT l_partkey) AS n_units,
min(on_date) AS first_on, max(on_date) AS last_on, arg_max(l_orderkey, (on_date, l_orderkey)) AS newest_event FROM changes GROUP BY 1"""
)
def root_index(spark, sf_dir):
    return record.root_index(_changes(spark, sf_dir), "o_custkey", "l_orderkey", "l_partkey", "on_date")


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER w AS step, lead(l_quantity) OVER w AS previous_l_quantity FROM lineitem
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC)"""
)
def provision_history(spark, sf_dir):
    recency = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return record.history(table(spark, sf_dir, "lineitem"), "l_partkey", recency, "l_quantity").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "step", "previous_l_quantity")


@query(
    """WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS on_date FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT o_orderkey, o_custkey, on_date, greatest((SELECT count(*) FROM f) - 200, 0) AS n_omitted FROM f ORDER BY on_date DESC, o_orderkey LIMIT 200"""
)
def changes_since_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("on_date"))
    return record.since(rows, F.col("on_date"), "1998-01-01", [F.desc("on_date"), F.col("o_orderkey")], 200)


@query(
    """SELECT c_custkey, c_nationkey, v.o_orderkey AS latest_order, v.o_orderstatus AS latest_status FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
)
def latest_change_per_item(spark, sf_dir):
    latest = record.latest_per(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.col("o_orderkey").alias("latest_order"), F.col("o_orderstatus").alias("latest_status"))


@query(
    """SELECT o_orderkey, first_value(o_orderstatus) OVER w AS newest, o_orderstatus IS DISTINCT FROM first_value(o_orderstatus) OVER w AS superseded FROM orders
WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def date_supersession(spark, sf_dir):
    return pairing.superseded(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_orderkey", "newest", "superseded")


@query("SELECT o_orderkey, o_orderdate FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def unannounced_anti(spark, sf_dir):
    announced = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(announced, "o_orderkey", "left_anti")


@query(
    """WITH f AS (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS d, (SELECT min(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey) AS f FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'bootstrap' WHEN d < DATE '1996-01-01' THEN 'before_live' WHEN date_diff('day', f, d) > 60 THEN 'stale' ELSE 'fresh' END AS judgement FROM f"""
)
def eligibility_case(spark, sf_dir):
    dates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("f"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("d")).join(dates, "o_orderkey", "left")
    return record.eligibility(orders, "d", "f", "1996-01-01", F.col("o_orderstatus") == "P").select("o_orderkey", "judgement")


_DIGITS = "list_sum(list_transform(range(1, {n} + 1), lambda i: substr({b}, i, 1)::INT * {w}))"


@query(
    f"""WITH b AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') AS six, lpad((p_partkey * 7919 % 100000000)::VARCHAR, 8, '0') AS eight FROM part),
s AS (SELECT p_partkey, {_DIGITS.format(n=6, b='six', w='(7 - i)')} AS r, {_DIGITS.format(n=6, b='six', w='i')} AS l, {_DIGITS.format(n=8, b='eight', w='i')} AS x FROM b)
SELECT p_partkey, (r % 10)::INT AS cas_digit, (CASE WHEN l % 11 = 10 THEN 1 ELSE l % 11 END)::INT AS ec_digit, CASE WHEN x % 11 = 10 THEN 'X' ELSE (x % 11)::INT::VARCHAR END AS index_sign FROM s"""
)
def identifier_check_digits(spark, sf_dir):
    six = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    eight = F.lpad((F.col("p_partkey") * 7919 % 100_000_000).cast("string"), 8, "0")
    return table(spark, sf_dir, "part").select("p_partkey", cas_check(six).alias("cas_digit"), ec_check(six).alias("ec_digit"), index_check(eight).alias("index_sign"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS n_holders, count(*) AS n_rows, min(l_orderkey) AS first_holder FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def identifier_inverted_index(spark, sf_dir):
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(brand, "l_partkey")
    return record.inverted(rows, "p_brand", "l_orderkey")


@query(
    """WITH h AS (SELECT l_orderkey, l_linenumber, unnest(['cas', 'ec', 'index']) AS scheme, unnest([l_partkey, l_suppkey, l_linenumber]) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, scheme, value, min(l_linenumber) AS first_line, count(*) AS n_rows FROM h WHERE scheme IN ('cas', 'ec') GROUP BY 1, 2, 3"""
)
def table_hit_flatten(spark, sf_dir):
    pairs = [("cas", "l_partkey"), ("ec", "l_suppkey"), ("index", "l_linenumber")]
    named = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(c).cast("long").alias("value")) for s, c in pairs])
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    hits = table(spark, sf_dir, "lineitem").join(events, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", F.explode(named).alias("i"))
    return hits.where("i.scheme IN ('cas', 'ec')").groupBy("l_orderkey", "i.scheme", "i.value").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("n_rows"))


@query(
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_open,
count(*) FILTER (o_orderstatus = 'P') AS n_pending, min(o_orderdate) AS oldest FROM orders GROUP BY 1"""
)
def status_aggregates(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(status == "F").alias("n_done"), F.count_if(status == "O").alias("n_open"),
        F.count_if(status == "P").alias("n_pending"), F.min("o_orderdate").alias("oldest"),
    )


@query(ORACLE["root_index"])
def index_snapshot(spark, sf_dir):
    """The indexes of all acts and of the record, published under one manifest, twice, and read from the newest."""
    base = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    acts, root = act_index(spark, sf_dir), root_index(spark, sf_dir)
    number = snapshots.publish(spark, base, {"acts": acts.limit(0), "root": root.limit(0)})
    snapshots.publish(spark, base, {"acts": acts, "root": root}, after=number)
    return snapshots.read(spark, base, "root")
