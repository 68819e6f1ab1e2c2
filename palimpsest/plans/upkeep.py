"""Queries on upkeep, search, coverage and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import comparison_text, digest, heading_key
from ..operators import maintenance, watch
from . import fixtures
from .fixtures import DELTA_SQL, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders WHERE o_orderstatus <> 'P'),
e AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT e.o_custkey, e.o_orderkey, coalesce(min(b.ord) FILTER (b.o_orderkey > e.o_orderkey), max(b.ord) + 1, 1) AS place FROM e LEFT JOIN b ON b.o_custkey = e.o_custkey GROUP BY 1, 2"""
)
def interleave_extras(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    base = orders.where("o_orderstatus <> 'P'").withColumn("ord", place)
    return maintenance.interleaved(base, orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "ord")


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END, s.in_force, DATE '2000-01-01') AS recency
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS in_force FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey"""
)
def event_recency(spark, sf_dir):
    dates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.to_date("l_shipdate")).alias("in_force"))
    orders = table(spark, sf_dir, "orders").join(dates, "o_orderkey", "left")
    known = F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))
    return orders.select("o_orderkey", F.coalesce(known, F.array_max("in_force"), F.to_date(F.lit("2000-01-01"))).alias("recency"))


@query(
    """WITH s AS (SELECT l_orderkey, coalesce(list_distinct(list(l_quantity::INT) FILTER (l_linenumber % 2 = 1)), []) AS o, coalesce(list_distinct(list(l_quantity::INT) FILTER (l_linenumber % 2 = 0)), []) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(n, x))), ',') AS removed, array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(o, x))), ',') AS added FROM s"""
)
def value_set_difference(spark, sf_dir):
    odd = F.col("l_linenumber") % 2 == 1
    q = F.col("l_quantity").cast("int")
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(odd, q)).alias("o"), F.collect_set(F.when(~odd, q)).alias("n"))
    removed, added = maintenance.moved_values(F.col("o"), F.col("n"))
    return sides.select("l_orderkey", F.array_join(removed, ",").alias("removed"), F.array_join(added, ",").alias("added"))


@query(f"WITH {DELTA_SQL} SELECT act, count(*) FILTER (change_type = 'inserted') AS n_gained, count(*) FILTER (change_type = 'deleted') AS n_dropped FROM delta WHERE change_type IN ('inserted', 'deleted') GROUP BY 1")
def unit_shift(spark, sf_dir):
    return maintenance.shift(fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir), "act", "location")


@query("SELECT l_partkey, l_suppkey, arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY 1, 2")
def pin_union(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"))
    return maintenance.first_kept(rows, ["l_partkey", "l_suppkey"], "ord", "l_returnflag")


@query("SELECT coalesce(c.k, w.k) AS k, coalesce(w.v, c.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) c FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) w ON c.k = w.k")
def provenance_overlay(spark, sf_dir):
    carried = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    written = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("v"))
    return maintenance.overlaid(carried, written, "k", "v")


@query(
    """WITH o AS (SELECT o_custkey AS key, max(o_orderstatus) AS status, count(*) AS tries FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1),
n AS (SELECT o_custkey AS key, min(o_orderstatus) AS status, count(*) AS tries FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
SELECT coalesce(o.key, n.key) AS key, coalesce(n.status, o.status) AS status, coalesce(o.tries, 0) + coalesce(n.tries, 0) AS tries FROM o FULL JOIN n ON o.key = n.key"""
)
def ledger_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus", (F.col("o_orderdate") < F.to_date(F.lit("1998-01-01"))).alias("old"))
    old = orders.where("old").groupBy("key").agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("tries"))
    new = orders.where("NOT old").groupBy("key").agg(F.min("o_orderstatus").alias("status"), F.count("*").alias("tries"))
    return maintenance.ledger(old, new, "key")


@query("SELECT DISTINCT l_partkey FROM lineitem l WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = l.l_partkey AND x.l_returnflag = 'R' AND x.l_linestatus = 'F')")
def insert_once(spark, sf_dir):
    from ..sources.record import inserted_once

    items = table(spark, sf_dir, "lineitem")
    return inserted_once(items.where("l_returnflag = 'R' AND l_linestatus = 'F'").select("l_partkey"), items.where("l_returnflag = 'A'").select("l_partkey"), ["l_partkey"])


@query("SELECT event_type, count(*) FILTER (ts::DATE >= DATE '2024-01-20') AS n_kept, count(*) FILTER (ts::DATE < DATE '2024-01-20') AS n_deleted FROM events GROUP BY 1")
def retention_sweep(spark, sf_dir):
    kept = F.to_date("ts") >= F.date_sub(F.to_date(F.lit("2024-03-20")), 60)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_deleted"))


@query(f"WITH {DELTA_SQL} SELECT location, CASE change_type WHEN 'inserted' THEN 'added' WHEN 'deleted' THEN 'withdrawn' WHEN 'unchanged' THEN 'carried' ELSE 'reasked' END AS plan FROM delta")
def evidence_comparison(spark, sf_dir):
    def stated(version):
        return version.select("location", digest(comparison_text(F.col("text"))).alias("digest"))

    return maintenance.evidence(stated(fixtures.before(spark, sf_dir)), stated(fixtures.after(spark, sf_dir)), "location", "digest")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'uncheckable' WHEN p_partkey IS NULL THEN 'absent' ELSE 'present' END AS resolution
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey"""
)
def citation_resolution(spark, sf_dir):
    offered = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(offered, "l_partkey", "left")
    resolution = F.when(F.col("l_partkey") % 5 == 0, F.lit("uncheckable")).when(F.col("there"), F.lit("present")).otherwise(F.lit("absent"))
    return cited.select("l_orderkey", "l_linenumber", "l_partkey", resolution.alias("resolution"))


@query(
    """WITH loc AS (SELECT DISTINCT 'AR ' || p_size || ' PA ' || (p_partkey % 7) AS location FROM part), u AS (SELECT DISTINCT 'AR ' || p_size AS unit FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT 'AR ' || p_size || ' PA ' || (p_partkey % 7) FROM part WHERE p_partkey % 7 = 3)
SELECT location, arg_min(unit, length(unit)) AS unit FROM loc LEFT JOIN u ON location = unit OR starts_with(location, unit || ' ') GROUP BY 1"""
)
def prefix_unit_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    article, paragraph = F.concat_ws(" ", F.lit("AR"), "p_size"), F.concat_ws(" ", F.lit("AR"), "p_size", F.lit("PA"), F.col("p_partkey") % 7)
    units = part.where("p_size % 2 = 0").select(article.alias("unit")).unionByName(part.where("p_partkey % 7 = 3").select(paragraph.alias("unit")))
    return maintenance.units_of(part.select(paragraph.alias("location")), units, "location", "unit")


@query("SELECT o_orderkey, o_orderdate, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def outbox_due(spark, sf_dir):
    """The oldest due rows; the limit is the size of a claim."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    due = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(users, "o_custkey", "left")
    return due.orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderdate", "c_mktsegment")


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_events, array_to_string(list_sort(list(DISTINCT l_orderkey), 'DESC')[:5], ',') AS newest FROM lineitem GROUP BY 1")
def instrument_inverse(spark, sf_dir):
    """For each amender the events it made, and its five newest (five are what a page shows)."""
    made = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_orderkey")))
    shown = F.collect_list(F.when(F.col("place") <= 5, F.col("l_orderkey")))
    return made.withColumn("place", place).groupBy("l_suppkey").agg(F.count("*").alias("n_events"), F.array_join(F.sort_array(shown, asc=False), ",").alias("newest"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def act_cascade(spark, sf_dir):
    keep = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keep, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT l_returnflag AS reason, count(*) AS n, count(DISTINCT l_orderkey) AS n_acts, min(l_shipdate) AS first_on, max(l_shipdate) AS last_on, count(*) FILTER (l_shipdate > DATE '2000-01-01') AS n_ahead, count(*) FILTER (l_shipdate BETWEEN DATE '1999-12-02' AND DATE '2000-01-01') AS n_recent FROM lineitem GROUP BY 1")
def date_coverage(spark, sf_dir):
    day, on = F.to_timestamp(F.lit("2000-01-01")), F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("reason")).agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_acts"), F.min("l_shipdate").alias("first_on"), F.max("l_shipdate").alias("last_on"),
        F.count_if(on > day).alias("n_ahead"), F.count_if(on.between(F.to_timestamp(F.lit("1999-12-02")), day)).alias("n_recent"),
    )


@query("SELECT year(o_orderdate)::INT AS in_year, count(*) AS n FROM orders GROUP BY 1")
def roster_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("in_year")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(o_orderpriority, 'all') AS act, count(*) FILTER (o_orderstatus = 'F') AS n_before, count(*) FILTER (o_orderstatus <> 'P') AS n_after FROM orders GROUP BY ROLLUP (o_orderpriority)")
def repair_tallies(spark, sf_dir):
    status = F.col("o_orderstatus")
    out = table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count_if(status == "F").alias("n_before"), F.count_if(status != "P").alias("n_after"))
    return out.select(F.coalesce("o_orderpriority", F.lit("all")).alias("act"), "n_before", "n_after")


@query("SELECT l_partkey, count(*) AS n_changes, max(l_orderkey) AS newest, arg_min(l_shipdate, (l_linenumber, l_shipdate)) FILTER (l_orderkey = m) AS heading FROM (SELECT *, max(l_orderkey) OVER (PARTITION BY l_partkey) AS m FROM lineitem) GROUP BY 1")
def provision_rows(spark, sf_dir):
    newest = F.max("l_orderkey").over(Window.partitionBy("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("m", newest)
    heading = F.min_by(F.col("l_shipdate"), F.when(F.col("l_orderkey") == F.col("m"), F.struct("l_linenumber", "l_shipdate")))
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n_changes"), F.max("l_orderkey").alias("newest"), heading.alias("heading"))


@query("SELECT n_name, count(*) AS n_units, round(count(*) FILTER (c_acctbal < 0) / nullif(count(*), 0)::DOUBLE, 9) AS share_disputed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def corpus_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = nation.join(table(spark, sf_dir, "customer"), "c_nationkey", "left")
    n = F.count("*")
    return joined.groupBy("n_name").agg(n.alias("n_units"), F.round(F.count_if(F.col("c_acctbal") < 0) / F.nullif(n, F.lit(0)), 9).alias("share_disputed"))


@query("SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def heading_equality(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", heading_key(F.concat(F.upper("p_name"), F.lit(" .:"))).alias("heading"))
    other = part.withColumnRenamed("p_partkey", "right_key")
    return part.withColumnRenamed("p_partkey", "left_key").join(other, ["p_brand", "p_size", "heading"]).where("left_key < right_key").select("left_key", "right_key")


@query(r"SELECT conv_id, turn, role, regexp_replace(regexp_replace(lower(role || ' ' || conv_id || '/' || turn), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN n < 100 THEN 'small' WHEN n < 1000 THEN 'medium' WHEN n < 10000 THEN 'large' ELSE 'huge' END AS weight, ceil(n / 2.25)::BIGINT AS tokens FROM (SELECT *, length(text) AS n FROM conversations)")
def slugs_and_weights(spark, sf_dir):
    n = F.char_length("text")
    raw = F.lower(F.concat(F.col("role"), F.lit(" "), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    slug = F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9]+", "-"), "^-|-$", "")
    weight = F.when(n < 100, F.lit("small")).when(n < 1000, F.lit("medium")).when(n < 10000, F.lit("large")).otherwise(F.lit("huge"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", slug.alias("slug"), weight.alias("weight"), F.ceil(n / F.lit(2.25)).cast("long").alias("tokens"))


@query(
    rf"""WITH {DELTA_SQL} SELECT location, sha256(location || '|' || CASE WHEN old_digest IS NULL THEN '-' ELSE '+' || old_digest END || '|' || CASE WHEN new_digest IS NULL THEN '-' ELSE '+' || new_digest END) AS sha FROM delta"""
)
def presence_digests(spark, sf_dir):
    from ..operators import versions

    delta = versions.diff_units(fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir))
    marked = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c))) for c in ("old_digest", "new_digest")]
    return delta.select("location", F.sha2(F.concat_ws("|", F.col("location").cast("string"), *marked), 256).alias("sha"))


@query(
    """WITH old AS (SELECT user_id AS key, min(ts)::DATE AS first_seen, max(ts)::DATE AS last_checked, count(DISTINCT ts::DATE)::INT AS checks FROM events WHERE event_type = 'click' GROUP BY 1),
seen AS (SELECT user_id AS key, bool_or(value > 60) AS resolved FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(o.key, s.key) AS key, coalesce(first_seen, DATE '2024-02-15') AS first_seen, CASE WHEN s.key IS NOT NULL THEN DATE '2024-02-15' ELSE last_checked END AS last_checked,
  (coalesce(checks, 0) + CASE WHEN s.key IS NOT NULL AND last_checked IS DISTINCT FROM DATE '2024-02-15' THEN 1 ELSE 0 END)::INT AS checks
FROM old o FULL JOIN seen s ON o.key = s.key WHERE NOT coalesce(resolved, false)"""
)
def pending_states(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    old = events.where("event_type = 'click'").groupBy(F.col("user_id").alias("key")).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_checked"), F.count_distinct("day").cast("int").alias("checks"))
    seen = events.where("event_type = 'error'").select(F.col("user_id").alias("key"), (F.col("value") > 60).alias("resolved"))
    return watch.pending(old, seen, "2024-02-15")


@query()
def rate_limit_fold(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return maintenance.accepted(hits, "user_id", "second", 3, 86_400)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'brand#2')")
def name_search(spark, sf_dir):
    wanted = [("p_name", "RING"), ("p_type", "RING"), ("p_brand", "BRAND#2")]
    hit = F.lit(False)
    for column, text in wanted:
        hit = hit | F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_name")


@query("SELECT source, count(*) AS n_versions, list_contains(list_transform(list(DISTINCT lang), lambda x: upper(x)), 'FR') AS has_french FROM documents GROUP BY 1")
def language_filter(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_versions"), F.collect_set("lang").alias("langs"))
    return langs.select("source", "n_versions", F.exists("langs", lambda x: F.upper(x) == F.upper(F.lit("fr"))).alias("has_french"))
