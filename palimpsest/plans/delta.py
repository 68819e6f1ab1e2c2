"""Queries on version deltas and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import comparison_text, contains_path, digest, natural_text, roman_value
from ..operators import pairing, signals, versions
from . import fixtures
from .fixtures import DELTA_SQL, RENUMBERED_SQL, SIGNALS_SQL, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.diff_units(fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir))


@query(f"WITH {DELTA_SQL} SELECT act, location, change_type, change_type = 'unchanged' AND old_verbatim IS DISTINCT FROM new_verbatim AS whitespace_only FROM delta")
def version_diff_units(spark, sf_dir):
    return _delta(spark, sf_dir).select("act", "location", "change_type", "whitespace_only")


_SUMMARY = """act, count(*) FILTER (change_type = 'inserted') AS n_inserted, count(*) FILTER (change_type = 'deleted') AS n_deleted,
count(*) FILTER (change_type = 'modified') AS n_modified, count(*) FILTER (change_type = 'renumbered') AS n_renumbered,
count(*) FILTER (change_type = 'unchanged') AS n_unchanged, count(*) FILTER (change_type <> 'unchanged') AS n_touched"""


@query(f"WITH {RENUMBERED_SQL} SELECT {_SUMMARY} FROM delta2 GROUP BY act")
def version_diff_summary(spark, sf_dir):
    return versions.summary(versions.with_renumbered(_delta(spark, sf_dir)), "act")


@query(f"WITH {DELTA_SQL} SELECT act, old_location, new_location FROM pairs")
def renumber_exact(spark, sf_dir):
    return versions.renumberings(_delta(spark, sf_dir))


@query(
    f"""WITH {RENUMBERED_SQL},
s AS (SELECT *, CASE WHEN new_pos IS NOT NULL THEN row_number() OVER (PARTITION BY act, new_pos IS NULL ORDER BY new_pos) - 1 END AS slot FROM delta2),
t AS (SELECT *, CASE WHEN old_pos IS NOT NULL THEN last_value(slot IGNORE NULLS) OVER (PARTITION BY act, old_pos IS NULL ORDER BY old_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ahead FROM s),
u AS (SELECT *, coalesce(slot, ahead + 1, 0) AS anchor FROM t)
SELECT act, location, change_type, row_number() OVER (PARTITION BY act ORDER BY anchor, (slot IS NOT NULL)::INT, old_pos NULLS FIRST, location) AS ord FROM u"""
)
def diff_emission_order(spark, sf_dir):
    ordered = versions.emission_order(versions.with_renumbered(_delta(spark, sf_dir)))
    return ordered.select("act", "location", "change_type", F.col("ord").cast("long").alias("ord"))


@query(r"SELECT doc_id, length(c) AS n_chars, sha256(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g')) AS c FROM documents)")
def comparison_normalise(spark, sf_dir):
    c = comparison_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(c).cast("long").alias("n_chars"), digest(c).alias("digest"))


@query(
    r"""WITH v AS (
  SELECT p_partkey AS key, p_name || ' ' || p_partkey AS value FROM part
  UNION ALL SELECT 1000000000 + c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'XIV' WHEN 1 THEN 'L' WHEN 2 THEN 'iv' WHEN 3 THEN c_name ELSE c_custkey || 'a' END FROM customer),
c AS (SELECT key, value, regexp_extract_all(value, '(\d+|[^\d]+)') AS runs FROM v)
SELECT key, value, CASE value WHEN 'XIV' THEN 14 ELSE 0 END AS roman,
  CASE value WHEN 'XIV' THEN '0' || lpad('2', 6, '0') || '14'
  ELSE array_to_string(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad(length(ltrim(r, '0'))::VARCHAR, 6, '0') || ltrim(r, '0') ELSE '1' || r END), chr(2)) END AS natural
FROM c"""
)
def natural_sort_keys(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    code = F.when(key % 5 == 0, F.lit("XIV")).when(key % 5 == 1, F.lit("L")).when(key % 5 == 2, F.lit("iv")).when(key % 5 == 3, F.col("c_name")).otherwise(F.concat(key.cast("string"), F.lit("a")))
    values = part.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_partkey").alias("value"))
    values = values.unionByName(customer.select((key + 1_000_000_000).alias("key"), code.alias("value")))
    return values.select("key", "value", F.coalesce(roman_value(F.col("value")), F.lit(0)).alias("roman"), natural_text(F.col("value")).alias("natural"))


@query(
    """WITH paths AS (SELECT n_nationkey AS id, 'RG ' || n_regionkey || ' NT ' || n_nationkey AS path FROM nation
  UNION ALL SELECT 1000 + r_regionkey, 'RG ' || r_regionkey FROM region)
SELECT o.id AS outer_id, i.id AS inner_id FROM paths o JOIN paths i ON i.path = o.path OR starts_with(i.path, o.path || ' ')"""
)
def path_containment_join(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    paths = nation.select(F.col("n_nationkey").alias("id"), F.concat_ws(" ", F.lit("RG"), "n_regionkey", F.lit("NT"), "n_nationkey").alias("path"))
    paths = paths.unionByName(region.select((F.col("r_regionkey") + 1000).alias("id"), F.concat_ws(" ", F.lit("RG"), "r_regionkey").alias("path")))
    # a path is in another only under one head, so the head is an equal key
    head = F.substring_index("path", " ", 2).alias("head")
    o = paths.select(F.col("id").alias("outer_id"), F.col("path").alias("outer_path"), head)
    i = paths.select(F.col("id").alias("inner_id"), F.col("path").alias("inner_path"), head)
    return o.join(i, "head").where(contains_path(F.col("outer_path"), F.col("inner_path"))).select("outer_id", "inner_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS occurrence FROM lineitem"""
)
def occurrence_numbering(spark, sf_dir):
    rows = pairing.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "occurrence")


_PAIRS = """n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
pairs AS (SELECT o_custkey, lag(o_orderkey) OVER w AS from_version, o_orderkey AS to_version, lag(o_orderdate) OVER w AS from_date, o_orderdate AS to_date,
  k - lag(k) OVER w - 1 AS bridged FROM n WHERE o_orderstatus <> 'P' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(f"WITH {_PAIRS} SELECT o_custkey, from_version, to_version, bridged FROM pairs WHERE from_version IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    return pairing.consecutive(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "P")


@query(
    f"""WITH {_PAIRS}, claims AS (SELECT o_custkey, l_shipdate AS on_date, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.o_custkey, from_version, to_version, count(*) AS n_claims, min(on_date) AS first_claim
FROM pairs p JOIN claims c ON c.o_custkey = p.o_custkey AND on_date > from_date AND on_date <= to_date
WHERE from_version IS NOT NULL GROUP BY 1, 2, 3"""
)
def claims_window_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    pairs = pairing.consecutive(orders, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "P")
    dates = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    dated = pairs.join(dates.withColumnsRenamed({"k": "from_version", "d": "from_date"}), "from_version").join(dates.withColumnsRenamed({"k": "to_version", "d": "to_date"}), "to_version")
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("on_date")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "on_date")
    inside = signals.in_window(F.col("on_date"), F.col("from_date"), F.col("to_date"))
    return dated.join(claims, "o_custkey").where(inside).groupBy("o_custkey", "from_version", "to_version").agg(F.count("*").alias("n_claims"), F.min("on_date").alias("first_claim"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = versions.with_renumbered(_delta(spark, sf_dir)).where("change_type <> 'unchanged'")
    unit = F.when(F.col("location") >= fixtures.SHIFT, F.col("location") - fixtures.SHIFT).otherwise(F.col("location"))
    kind = F.when(F.col("change_type") == "renumbered", F.lit("modified")).otherwise(F.col("change_type"))
    diff = delta.select("act", unit.alias("unit"), kind.alias("diff_kind"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("act"))
    claimed = F.when(F.col("toxic") == 1, F.lit("modified")).when(F.col("quality") == 0, F.lit("deleted"))
    labelled = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("act", F.col("doc_id").alias("unit")).agg(F.max(claimed).alias("claimed_kind"))
    return signals.merged(diff, labelled.where("claimed_kind IS NOT NULL"), labelled)


@query(f"WITH {SIGNALS_SQL} SELECT act, unit, diff_kind, claimed_kind, diff_status, claim_status, textless FROM merged")
def three_way_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("act", "unit", "diff_kind", "claimed_kind", "diff_status", "claim_status", "textless")


@query(f"WITH {SIGNALS_SQL} SELECT act, unit, disputed, reason FROM disputed")
def dispute_reason(spark, sf_dir):
    return signals.disputed(_merged(spark, sf_dir)).select("act", "unit", "disputed", "reason")


_AGREED = ", ".join(["act", "n_diff", "n_claimed", "n_shared", "n_kind_mismatch", *[f"round({c}, 9) AS {c}" for c in ("precision", "recall", "f1")]])


@query(f"WITH {SIGNALS_SQL} SELECT {_AGREED} FROM agreed")
def signal_agreement(spark, sf_dir):
    out = signals.agreement(_merged(spark, sf_dir), "act")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"WITH {SIGNALS_SQL} SELECT act, coalesce(diff_kind, 'NONE') AS diff_label, coalesce(claimed_kind, 'NONE') AS claim_label, count(*) AS n FROM merged GROUP BY 1, 2, 3")
def confusion_cells(spark, sf_dir):
    return signals.confusion(_merged(spark, sf_dir), "act")


_POOLED = ", ".join(["n_diff", "n_claimed", "n_shared", *[f"round({c}, 9) AS {c}" for c in ("macro_f1", "micro_precision", "micro_recall", "micro_f1")]])


def _pooled(spark, sf_dir):
    return signals.pooled(signals.agreement(_merged(spark, sf_dir), "act"))


@query(f"WITH {SIGNALS_SQL} SELECT {_POOLED} FROM pool3")
def micro_macro_rollup(spark, sf_dir):
    return _pooled(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("macro_f1", "micro_precision", "micro_recall", "micro_f1")})


#: Least values of the pooled figures, and how far one may fall short.
FLOORS = {"micro_f1": 0.1, "macro_f1": 0.9, "micro_recall": 0.2}
TOLERANCE = 0.005


@query(
    f"""WITH {SIGNALS_SQL}, m AS (SELECT unnest(['micro_f1', 'macro_f1', 'micro_recall']) AS metric, unnest([micro_f1, macro_f1, micro_recall]) AS value,
unnest([0.1, 0.9, 0.2])::DOUBLE AS floor FROM pool3) SELECT metric, round(value, 9) AS value, floor, value < floor - 0.005 AS breached FROM m"""
)
def metric_floors(spark, sf_dir):
    return signals.breaches(_pooled(spark, sf_dir), FLOORS, TOLERANCE).withColumn("value", F.round("value", 9))


@query(
    f"""WITH {SIGNALS_SQL}, codes AS (SELECT unnest(['textless', 'silent', 'kind', 'undated']) AS reason)
SELECT c.reason, count(d.reason) AS n FROM codes c LEFT JOIN disputed d ON c.reason = d.reason GROUP BY 1"""
)
def disputed_histogram_zero_filled(spark, sf_dir):
    from ..operators.record import zero_filled

    counts = signals.disputed(_merged(spark, sf_dir)).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    codes = spark.createDataFrame([(c,) for c in ("textless", "silent", "kind", "undated")], "reason string")
    return zero_filled(counts, codes, "reason")


@query(
    f"""WITH {DELTA_SQL} SELECT coalesce(o.act, n.act) || '/' || coalesce(o.location, n.location) AS key,
CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' WHEN o.digest = n.digest THEN 'kept' ELSE 'rewritten' END AS action
FROM o FULL JOIN n ON o.act = n.act AND o.location = n.location"""
)
def hash_incremental_load(spark, sf_dir):
    def listing(version):
        return version.select(F.concat_ws("/", "act", "location").alias("key"), digest(comparison_text(F.col("text"))).alias("sha"))

    return versions.changed_since(listing(fixtures.before(spark, sf_dir)), listing(fixtures.after(spark, sf_dir)))


@query(r"SELECT digest, count(*) AS n_nodes, min(doc_id) AS first_location FROM (SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))) AS digest FROM documents) GROUP BY 1")
def text_digest_dedupe(spark, sf_dir):
    return versions.digest_pools(fixtures.before(spark, sf_dir))


@query(
    """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
w AS (SELECT source, n, least(12, n) AS k FROM (SELECT DISTINCT source, n FROM p)),
a AS (SELECT source, n, k, unnest(range(0, k)) AS j FROM w),
c AS (SELECT DISTINCT source, CASE WHEN k = 1 THEN 0 ELSE round_even(j * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT END AS i FROM a)
SELECT p.source, p.doc_id FROM p JOIN c ON p.source = c.source AND p.i = c.i"""
)
def evenly_spaced_sample(spark, sf_dir):
    return pairing.evenly_spaced(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 12)
