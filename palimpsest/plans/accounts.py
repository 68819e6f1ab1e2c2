"""Queries that account for runs: counts, rates, filters, orders and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import natural_text
from ..operators.ranking import ranked
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


@query("SELECT lang, sum(n)::BIGINT AS n_documents, sum(chars)::BIGINT AS n_chars, sum(empty)::BIGINT AS n_empty FROM (SELECT lang, source, count(*) AS n, sum(length(text)) AS chars, count(*) FILTER (text = '') AS empty FROM documents GROUP BY 1, 2) GROUP BY 1")
def coverage_merge(spark, sf_dir):
    """Counts of parts merged to those of the whole, element by element."""
    parts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("text") == "").alias("empty"))
    return parts.groupBy("lang").agg(F.sum("n").alias("n_documents"), F.sum("chars").alias("n_chars"), F.sum("empty").alias("n_empty"))


@query("SELECT page_id % 7 AS part, count(*) FILTER (html LIKE '%<table%') AS with_table, count(*) FILTER (html LIKE '%<script%') AS with_script, count(*) FILTER (NOT html LIKE '%<%') AS unread FROM pages GROUP BY 1")
def parser_coverage(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy((F.col("page_id") % 7).alias("part")).agg(F.count_if(F.col("html").contains("<table")).alias("with_table"), F.count_if(F.col("html").contains("<script")).alias("with_script"), F.count_if(~F.col("html").contains("<")).alias("unread"))


@query("SELECT event_type, count(*) AS n_cases, sum(value) IS NULL AS empty, round(count(*) FILTER (value > 50) / nullif(count(*), 0)::DOUBLE, 9) AS grounded, round(count(*) FILTER (value <= 50 AND event_id % 5 = 0) / nullif(count(*) FILTER (event_id % 5 = 0), 0)::DOUBLE, 9) AS fallback FROM events GROUP BY 1")
def model_pooling(spark, sf_dir):
    high, fifth = F.col("value") > 50, F.col("event_id") % 5 == 0
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_cases"), F.sum("value").isNull().alias("empty"), F.count_if(high).alias("h"), F.count_if(~high & fifth).alias("f"), F.count_if(fifth).alias("n5"))
    return sums.select("event_type", "n_cases", "empty", F.round(F.try_divide("h", "n_cases"), 9).alias("grounded"), F.round(F.try_divide("f", "n5"), 9).alias("fallback"))


@query("SELECT count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (quality = 1 AND toxic = 0) AS lenient, count(*) FILTER (quality = 0 AND toxic = 1) AS strict, count(*) AS n FROM labels")
def judge_score(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").agg(F.count_if(q == t).alias("agree"), F.count_if((q == 1) & (t == 0)).alias("lenient"), F.count_if((q == 0) & (t == 1)).alias("strict"), F.count("*").alias("n"))


@query("SELECT role, count(*) AS n_calls, sum(length(text)) AS n_in, count(*) * 351 AS n_out, round(sum(length(text)) / 2.25 * 3e-6 + count(*) * 351 * 15e-6, 6) AS cost FROM conversations GROUP BY 1")
def usage_costs(spark, sf_dir):
    sums = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n_calls"), F.sum(F.char_length("text")).alias("n_in"))
    return sums.select("role", "n_calls", "n_in", (F.col("n_calls") * 351).alias("n_out"), F.round(F.col("n_in") / 2.25 * 3e-6 + F.col("n_calls") * 351 * 15e-6, 6).alias("cost"))


@query("SELECT CASE WHEN l_quantity < 10 THEN 'passed' WHEN l_discount > 0.08 THEN 'retried' WHEN l_tax = 0 THEN 'withheld' ELSE 'first' END AS outcome, count(*) AS n, count(DISTINCT l_orderkey) AS n_events FROM lineitem GROUP BY 1")
def gate_statistics(spark, sf_dir):
    outcome = F.when(F.col("l_quantity") < 10, "passed").when(F.col("l_discount") > 0.08, "retried").when(F.col("l_tax") == 0, "withheld").otherwise("first")
    return table(spark, sf_dir, "lineitem").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_events"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def run_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS k FROM events)
SELECT ts::DATE AS day, count(*) AS n_entries, count(*) FILTER (k > 1) AS n_repeats, count(*) FILTER (k = 1 AND event_type = 'error') AS n_waiting, greatest(0, date_diff('day', min(ts::DATE) FILTER (k = 1 AND event_type = 'error'), DATE '2024-01-15')) AS oldest FROM e GROUP BY 1"""
)
def poll_statistics(spark, sf_dir):
    """Entries of a day, repeats, those that wait, and the age of the oldest of them, not below zero."""
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("first", F.row_number().over(w) == 1).withColumn("day", F.to_date("ts"))
    waits = F.col("first") & (F.col("event_type") == "error")
    age = F.greatest(F.lit(0), F.datediff(F.lit("2024-01-15").cast("date"), F.min(F.when(waits, F.col("day")))))
    return events.groupBy("day").agg(F.count("*").alias("n_entries"), F.count_if(~F.col("first")).alias("n_repeats"), F.count_if(waits).alias("n_waiting"), age.cast("long").alias("oldest"))


@query("SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag <> 'N') + count(*) FILTER (l_returnflag = 'N' AND l_tax > 0.05) = 0 THEN 1.0 ELSE round(count(*) FILTER (l_returnflag <> 'N') / (count(*) FILTER (l_returnflag <> 'N') + count(*) FILTER (l_returnflag = 'N' AND l_tax > 0.05))::DOUBLE, 9) END::DOUBLE AS coverage FROM lineitem GROUP BY 1")
def instruction_coverage(spark, sf_dir):
    """Read of read and unread; whole where there is nothing to read."""
    read, unread = F.count_if(F.col("l_returnflag") != "N"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.05))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.coalesce(F.try_divide(read, read + unread), F.lit(1.0)), 9).alias("coverage"))


@query(
    """WITH f AS (SELECT p_name AS label, 'part' AS kind, arg_max(p_partkey, p_partkey) AS target FROM part GROUP BY 1), b AS (SELECT p_brand AS label, 'brand' AS kind, max(p_partkey) AS target FROM part GROUP BY 1),
u AS (SELECT * FROM f UNION ALL SELECT * FROM b) SELECT label, kind, target, row_number() OVER (ORDER BY lower(label), kind, target) AS ord FROM u"""
)
def search_index(spark, sf_dir):
    """The newest target of each name, of all kinds of names, in the order of their folded labels."""
    part = table(spark, sf_dir, "part")
    rows = [part.groupBy(F.col(c).alias("label")).agg(F.max("p_partkey").alias("target")).withColumn("kind", F.lit(k)) for c, k in (("p_name", "part"), ("p_brand", "brand"))]
    both = rows[0].unionByName(rows[1]).withColumn("folded", F.lower("label"))
    return ranked(both, ["folded", "kind", "target"], "ord").select("label", "kind", "target", "ord")


@query("SELECT p_name, arg_min(p_brand, p_partkey) AS target FROM part WHERE p_size > 10 GROUP BY 1")
def labels_of_unpaged(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 10").groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("target"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, max(o_orderdate)::DATE AS run_date FROM orders GROUP BY 1")
def newest_report(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"), F.to_date(F.max("o_orderdate")).alias("run_date"))


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def first_per_coordinate(spark, sf_dir):
    """The newest entry of each coordinate."""
    newest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("e"))
    return newest.select("user_id", "event_type", "e.event_id", F.get_json_object("e.props", "$.k").cast("bigint").alias("k"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AND o_totalprice > 100000 AS alert, o_orderpriority = '5-LOW' AND o_orderstatus <> 'F' AS unattributed, CASE WHEN o_orderstatus = 'P' THEN FALSE ELSE o_orderdate >= DATE '1996-06-01' END AS in_cutoff, o_orderstatus = 'O' AND o_custkey % 4 >= 3 AS exhausted FROM orders")
def event_predicates(spark, sf_dir):
    """Date alert, unattributed, cutoff (no date: false) and retry exhausted, for each event."""
    status = F.col("o_orderstatus")
    day = F.when(status != "P", F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (status.isin("F", "P") & (F.col("o_totalprice") > 100_000)).alias("alert"),
        ((F.col("o_orderpriority") == "5-LOW") & (status != "F")).alias("unattributed"),
        F.coalesce(day >= F.lit("1996-06-01").cast("date"), F.lit(False)).alias("in_cutoff"),
        ((status == "O") & (F.col("o_custkey") % 4 >= 3)).alias("exhausted"),
    )


@query("SELECT c_custkey, min(o_orderkey) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate = TIMESTAMP '1998-10-03' AND o_orderpriority = '5-LOW' GROUP BY 1")
def version_selector(spark, sf_dir):
    """The version of a date and form that each act has, if any."""
    wanted = table(spark, sf_dir, "orders").where("o_orderdate = TIMESTAMP '1998-10-03' AND o_orderpriority = '5-LOW'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("version"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(wanted, "c_custkey", "left")


@query(
    """WITH v AS (SELECT l_orderkey, l_partkey % 20 AS version, list(DISTINCT l_returnflag || l_linestatus) AS forms, min(l_shipdate)::DATE AS day FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2)
SELECT l_orderkey, version, array_to_string(list_sort(forms), ',') AS forms, row_number() OVER (PARTITION BY l_orderkey ORDER BY day NULLS FIRST, version) AS ord FROM v"""
)
def version_merge(spark, sf_dir):
    """Versions of an act found under several relations: the union of their forms, oldest first; other acts' are dropped."""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").withColumn("version", F.col("l_partkey") % 20)
    merged = rows.groupBy("l_orderkey", "version").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("forms"), F.min(F.to_date("l_shipdate")).alias("day"))
    return merged.select("l_orderkey", "version", "forms", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("day").asc_nulls_first(), "version")).cast("long").alias("ord"))


@query(
    """WITH w AS (SELECT c_custkey AS id, CASE WHEN c_nationkey IS NULL THEN 'pending' WHEN c_mktsegment = 'MACHINERY' THEN 'language' WHEN n IS NULL THEN 'format' ELSE 'text' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey)
SELECT state, count(*) AS n, min(id) AS first_id FROM w GROUP BY 1"""
)
def version_text_states(spark, sf_dir):
    """What each version has to give: its text, or why not."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("c_nationkey").isNull(), "pending").when(F.col("c_mktsegment") == "MACHINERY", "language").when(F.col("n").isNull(), "format").otherwise("text")
    return table(spark, sf_dir, "customer").join(held, "c_custkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))


@query(
    """WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS path, r_name AS name, 0 AS depth FROM region UNION ALL SELECT t.path || '/N' || lpad(n_nationkey::VARCHAR, 3, '0'), n_name, 1 FROM nation JOIN t ON t.path = 'R' || n_regionkey AND t.depth = 0)
SELECT path, name, depth, row_number() OVER (ORDER BY path) AS pos FROM t"""
)
def tree_walk(spark, sf_dir):
    """Nodes of a tree, known by their parents, in document order; a location is found by equality."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    roots = region.select("r_regionkey", F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("name"), F.lit(0).alias("depth"))
    below = nation.join(roots.select("r_regionkey", F.col("path").alias("up")), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = below.select(F.concat("up", F.lit("/N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("path"), F.col("n_name").alias("name"), F.lit(1).alias("depth"))
    return ranked(roots.drop("r_regionkey").unionByName(leaves), ["path"], "pos")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS ord FROM lineitem")
def change_sort(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.row_number().over(w).cast("long").alias("ord"))


@query("WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cas' ELSE 'ec' END AS scheme, (c_custkey % 97) || '-' || (c_custkey % 13) AS v FROM customer) SELECT c_custkey, row_number() OVER (ORDER BY scheme, split_part(v, '-', 1)::INT, split_part(v, '-', 2)::INT, c_custkey) AS ord FROM i")
def identifier_order(spark, sf_dir):
    """Identifiers by scheme, then by their runs of digits as numbers."""
    k = F.col("c_custkey")
    value = F.concat_ws("-", (k % 97).cast("string"), (k % 13).cast("string"))
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 2 == 0, "cas").otherwise("ec").alias("scheme"), natural_text(value).alias("key"))
    return ranked(rows, ["scheme", "key", "c_custkey"], "ord").select("c_custkey", "ord")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def early_stop_limit(spark, sf_dir):
    """The newest 500 changes that match (a limit that is the feature)."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def home_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_custkey", "o_orderkey")


@query("SELECT c_mktsegment AS sector, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment = 'MACHINERY', lower(c_mktsegment), c_mktsegment) AS ord FROM customer GROUP BY 1")
def sector_table(spark, sf_dir):
    """Sectors by folded name, the one for all others last."""
    sectors = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("n"))
    keyed = sectors.withColumn("last", F.col("sector") == "MACHINERY").withColumn("folded", F.lower("sector"))
    return ranked(keyed, ["last", "folded", "sector"], "ord").select("sector", "n", "ord")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord FROM lineitem")
def dump_order(spark, sf_dir):
    """A whole table by its key, ranked without one task that sorts it."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return ranked(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "ord").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ord")


@query("SELECT event_type, count(DISTINCT event_id) FILTER (date_diff('day', ts::DATE, DATE '2024-03-10') <= 60) AS n_entries, count(DISTINCT user_id || '/' || event_type) FILTER (date_diff('day', ts::DATE, DATE '2024-03-10') <= 365) AS n_keys FROM events GROUP BY 1")
def state_expiry(spark, sf_dir):
    """What a poll's state keeps: entries 60 days, resolved keys 365 days after they were seen."""
    age = F.datediff(F.lit("2024-03-10").cast("date"), F.to_date("ts"))
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct(F.when(age <= 60, F.col("event_id"))).alias("n_entries"), F.countDistinct(F.when(age <= 365, key)).alias("n_keys"))


@query("SELECT doc_id, length(text) AS n_bytes, sha256(text) AS sha, sha256(text) = sha256(CASE WHEN doc_id % 19 = 0 THEN text || ' ' ELSE text END) AS verified FROM documents")
def record_hash_check(spark, sf_dir):
    """Payloads read against the digests that their index holds."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    read = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n_bytes"), digest(F.col("text")).alias("sha"), (digest(F.col("text")) == digest(read)).alias("verified"))
