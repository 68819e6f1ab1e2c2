"""Queries on tables of entries, claims and joins of the record."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import comparison_text, digest
from ..operators import entries, memo, pairing, similarity
from ..operators.stages import shared_dir, staged
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


#: Order lines as rows of tables: an act's table is an order, an entry's key a part; the second version drops, adds,
#: respaces and amends some of them.
_ROWS_SQL = """rows AS (SELECT l_orderkey, l_partkey % 50 AS key, l_linenumber AS pos, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50 ORDER BY l_linenumber, l_suppkey, l_shipdate, l_partkey, l_extendedprice) AS occurrence, l_returnflag || ' é ' || l_quantity::INT AS cell FROM lineitem),
o AS (SELECT l_orderkey, key, occurrence, cell FROM rows WHERE key % 10 <> 3),
n AS (SELECT l_orderkey, key, occurrence, CASE key % 10 WHEN 1 THEN cell || ' ' WHEN 2 THEN replace(cell, 'é', 'e') WHEN 4 THEN cell || ' x' ELSE cell END AS cell FROM rows WHERE key % 10 <> 5 AND NOT (key % 10 = 6 AND occurrence > 1)),
ko AS (SELECT l_orderkey, key, count(*) AS k FROM o GROUP BY 1, 2), kn AS (SELECT l_orderkey, key, count(*) AS k FROM n GROUP BY 1, 2),
diff AS (SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, coalesce(o.key, n.key) AS key, coalesce(o.occurrence, n.occurrence) AS occurrence,
  CASE WHEN kn.k IS NULL THEN 'removed' WHEN ko.k IS NULL THEN 'added' WHEN ko.k <> kn.k THEN 'unpaired' WHEN o.cell = n.cell THEN 'unchanged' WHEN trim(o.cell) = trim(n.cell) THEN 'whitespace' ELSE 'amended' END AS change,
  o.cell AS oc, n.cell AS nc FROM o FULL JOIN n USING (l_orderkey, key, occurrence) LEFT JOIN ko ON ko.l_orderkey = coalesce(o.l_orderkey, n.l_orderkey) AND ko.key = coalesce(o.key, n.key) LEFT JOIN kn ON kn.l_orderkey = coalesce(o.l_orderkey, n.l_orderkey) AND kn.key = coalesce(o.key, n.key)),
told AS (SELECT l_orderkey, key, CASE WHEN change = 'unpaired' THEN 0 ELSE occurrence END::INT AS occurrence, change, change = 'amended' AND strip_accents(replace(oc, ' ', '')) = strip_accents(replace(nc, ' ', '')) AS typography_only FROM diff WHERE change <> 'unpaired' OR occurrence = 1)"""


def _versions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_partkey") % 50)
    items = pairing.numbered(items, ["l_orderkey", "key"], ["l_linenumber", "l_suppkey", "l_shipdate", "l_partkey", "l_extendedprice"])
    rows = items.select("l_orderkey", "key", "occurrence", F.concat_ws(" ", "l_returnflag", F.lit("é"), F.col("l_quantity").cast("int")).alias("cell"))
    k, cell = F.col("key") % 10, F.col("cell")
    edited = F.when(k == 1, F.concat(cell, F.lit(" "))).when(k == 2, F.replace(cell, F.lit("é"), F.lit("e"))).when(k == 4, F.concat(cell, F.lit(" x"))).otherwise(cell)
    return rows.where(k != 3), rows.where((k != 5) & ~((k == 6) & (F.col("occurrence") > 1))).withColumn("cell", edited)


def _told(spark, sf_dir):
    return entries.difference(*_versions(spark, sf_dir), ["l_orderkey"], "key", "cell")


@query(f"WITH {_ROWS_SQL} SELECT l_orderkey, key, occurrence, change, coalesce(typography_only, FALSE) AS typography_only FROM told")
def table_entry_diff(spark, sf_dir):
    return _told(spark, sf_dir)


@query(f"WITH {_ROWS_SQL} SELECT change, count(*) AS n, count(*) FILTER (typography_only) AS n_typography, count(DISTINCT l_orderkey) AS n_tables FROM told GROUP BY 1")
def table_entry_counts(spark, sf_dir):
    told = _told(spark, sf_dir)
    return told.groupBy("change").agg(F.count("*").alias("n"), F.count_if("typography_only").alias("n_typography"), F.countDistinct("l_orderkey").alias("n_tables"))


@query(f"WITH {_ROWS_SQL} SELECT l_orderkey, key, occurrence, row_number() OVER (PARTITION BY l_orderkey ORDER BY key, occurrence, change) AS ord FROM told WHERE change NOT IN ('unchanged', 'whitespace')")
def entry_order(spark, sf_dir):
    """Changes of a table in the order of their keys and occurrences."""
    changed = _told(spark, sf_dir).where("change NOT IN ('unchanged', 'whitespace')")
    return changed.select("l_orderkey", "key", "occurrence", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("key", "occurrence", "change")).cast("long").alias("ord"))


@query(
    """WITH r AS (SELECT conv_id, turn, role, text FROM conversations), h AS (SELECT DISTINCT conv_id, left(text, 12) AS line FROM r WHERE turn = 0)
SELECT r.conv_id, count(*) AS n_body FROM r LEFT JOIN h ON h.conv_id = r.conv_id AND h.line = left(r.text, 12) WHERE r.turn <> 0 AND h.line IS NULL AND trim(r.text) <> '' GROUP BY 1"""
)
def body_row_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("line", F.substring("text", 1, 12))
    body = entries.body_rows(rows, ["conv_id"], "line", F.col("turn") == 0, F.trim("text") == "")
    return body.groupBy("conv_id").agg(F.count("*").alias("n_body"))


@query(
    """WITH b AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS begins FROM (SELECT conv_id, turn // 3 AS turn3, turn, CASE WHEN turn % 3 = 2 THEN 'assistant' ELSE role END AS role FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
e AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS entry FROM b), g AS (SELECT conv_id, role, entry, count(*) AS n_rows FROM e GROUP BY 1, 2, 3)
SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY entry) AS occurrence, n_rows FROM g"""
)
def entry_grouping(spark, sf_dir):
    """Rows grouped to entries: one whose key repeats the key before continues its entry."""
    role = F.when(F.col("turn") % 3 == 2, F.lit("assistant")).otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), F.col("role").alias("said"))
    found = entries.grouped(rows, ["conv_id"], "role", ["turn", "role"], ["said"])
    return found.select("conv_id", "role", F.col("occurrence").cast("long").alias("occurrence"), F.size("rows").cast("long").alias("n_rows"))


@query("SELECT t.o_orderkey, p.profile FROM (SELECT o_orderkey, o_orderpriority FROM orders) t JOIN (VALUES ('urgent', 'urgent'), ('high', 'high'), ('spec', 'specified'), ('low', 'low')) p(profile, word) ON regexp_matches(lower(t.o_orderpriority), '\\b' || p.word || '\\b')")
def table_profile_lookup(spark, sf_dir):
    """Tables whose header has all words of a profile, whole and in any case."""
    profiles = {"urgent": ["urgent"], "high": ["high"], "spec": ["specified"], "low": ["low"]}
    header = F.array_distinct(F.filter(F.split(F.lower("o_orderpriority"), r"\W+"), lambda w: w != ""))
    held = F.map_filter(F.create_map(*[x for k, v in profiles.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), lambda k, v: F.size(F.array_except(v, header)) == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.map_keys(held)).alias("profile"))


_CLAIMS_SQL = """claims AS (SELECT o_custkey AS unit, l_orderkey AS act, CASE WHEN l_linenumber % 2 = 1 THEN 'metadata' ELSE 'instructions' END AS signal, l_shipdate, l_returnflag AS kind, l_linenumber > 4 AS deeper FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _claims(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("unit"))
    signal = F.when(F.col("l_linenumber") % 2 == 1, F.lit("metadata")).otherwise(F.lit("instructions"))
    items = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    return items.select("unit", F.col("l_orderkey").alias("act"), signal.alias("signal"), "l_shipdate", F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") > 4).alias("deeper"))


@query(
    f"""WITH {_CLAIMS_SQL}, f AS (SELECT unit, act, min((signal = 'instructions')::INT) AS s, arg_min(l_shipdate, ((signal = 'instructions')::INT, l_shipdate)) AS d FROM claims GROUP BY 1, 2)
SELECT unit, array_to_string(list(act ORDER BY s, d, act), ',') AS amenders FROM f GROUP BY 1"""
)
def amenders_distinct(spark, sf_dir):
    """The acts that claims of a unit name, each once, those of metadata before those of instructions."""
    order = F.struct((F.col("signal") == "instructions").cast("int").alias("s"), F.col("l_shipdate").alias("d"))
    firsts = _claims(spark, sf_dir).groupBy("unit", "act").agg(F.min(order).alias("o"))
    return firsts.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "act"))), lambda x: x["act"].cast("string")), ",").alias("amenders"))


@query(f"WITH {_CLAIMS_SQL} SELECT unit, array_to_string(list_sort(list(DISTINCT CASE WHEN deeper OR kind = 'N' THEN 'modified' WHEN kind = 'R' THEN 'deleted' ELSE 'inserted' END)), ',') AS kinds FROM claims GROUP BY 1")
def kinds_per_unit(spark, sf_dir):
    """Kinds that claims give a unit; a claim below the unit is a modification of it."""
    kind = F.when(F.col("deeper") | (F.col("kind") == "N"), F.lit("modified")).when(F.col("kind") == "R", F.lit("deleted")).otherwise(F.lit("inserted"))
    return _claims(spark, sf_dir).groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


@query(f"WITH {_CLAIMS_SQL} SELECT DISTINCT unit, signal FROM claims WHERE NOT deeper")
def distinct_units(spark, sf_dir):
    return _claims(spark, sf_dir).where("NOT deeper").select("unit", "signal").distinct()


@query(
    f"""WITH {_CLAIMS_SQL}, m AS (SELECT DISTINCT unit FROM claims WHERE signal = 'metadata'), i AS (SELECT unit, bool_or(deeper) AS deeper FROM claims WHERE signal = 'instructions' GROUP BY 1), d AS (SELECT c_custkey AS unit, c_nationkey % 3 AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(d.unit, m.unit, i.unit) AS unit, d.unit IS NOT NULL AS in_diff, m.unit IS NOT NULL AS in_metadata, i.unit IS NOT NULL AS in_instructions, coalesce(i.deeper, FALSE) AS deeper, d.unit IS NULL AND m.unit IS NULL AS instruction_only
FROM d FULL JOIN m ON d.unit = m.unit FULL JOIN i ON i.unit = coalesce(d.unit, m.unit)"""
)
def three_signal_merge(spark, sf_dir):
    """Diff and two claim sets by unit; a unit that only instructions name stands apart."""
    claims = _claims(spark, sf_dir)
    diff = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("unit"), F.lit(True).alias("in_diff"))
    metadata = claims.where("signal = 'metadata'").select("unit", F.lit(True).alias("in_metadata")).distinct()
    told = claims.where("signal = 'instructions'").groupBy("unit").agg(F.bool_or("deeper").alias("deeper"), F.lit(True).alias("in_instructions"))
    merged = diff.join(metadata, "unit", "full").join(told, "unit", "full").na.fill(False)
    return merged.select("unit", "in_diff", "in_metadata", "in_instructions", "deeper", (~F.col("in_diff") & ~F.col("in_metadata")).alias("instruction_only"))


@query(
    """SELECT o_custkey, count(*) FILTER (o_orderdate > DATE '1995-01-01' AND o_orderdate <= DATE '1997-01-01' AND o_orderstatus <> 'P') AS n_in, count(*) FILTER (o_orderstatus <> 'P' AND NOT (o_orderdate > DATE '1995-01-01' AND o_orderdate <= DATE '1997-01-01')) AS n_out,
count(*) FILTER (o_orderstatus = 'P') AS n_undated FROM orders GROUP BY 1"""
)
def window_scoping(spark, sf_dir):
    """Claims in a half-open window, and how many lie outside or have no date."""
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    inside = (day > F.lit("1995-01-01").cast("date")) & (day <= F.lit("1997-01-01").cast("date"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"), F.count_if(day.isNull()).alias("n_undated"))


@query(f"WITH {DELTA_SQL}, named AS (SELECT doc_id AS location FROM labels UNION SELECT item_id + 50000000 FROM benchmark) SELECT d.location, d.location IS NOT NULL AND x.location IS NOT NULL AS found, n.location AS wanted FROM named n LEFT JOIN (SELECT DISTINCT location FROM delta) d ON d.location = n.location LEFT JOIN (SELECT DISTINCT location FROM delta) x ON x.location = n.location")
def delta_restriction(spark, sf_dir):
    """Units asked for that a delta has, and those it lacks."""
    from ..operators import versions

    delta = versions.diff_units(fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir)).select("location").distinct()
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("wanted")).union(table(spark, sf_dir, "benchmark").select(F.col("item_id") + 50_000_000)).distinct()
    return wanted.join(delta, F.col("wanted") == F.col("location"), "left").select("location", F.col("location").isNotNull().alias("found"), "wanted")


@query(
    f"""WITH {DELTA_SQL} SELECT d.act, d.location, d.change_type, d.change_type <> 'modified' OR left(x.text, 2000) IS DISTINCT FROM left(y.text, 2000) AS explainable
FROM delta d LEFT JOIN a x ON x.act = d.act AND x.location = d.location LEFT JOIN b y ON y.act = d.act AND y.location = d.location WHERE d.change_type <> 'unchanged'"""
)
def explainable_changes(spark, sf_dir):
    """Changes with a text whose two sides, as far as they are shown, tell a difference."""
    from ..operators import signals, versions

    before, after = fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir)
    units = versions.diff_units(before, after).where("change_type <> 'unchanged'").select("act", "location", "change_type")
    shown = units.join(before.select("act", "location", F.col("text").alias("old")), ["act", "location"], "left").join(after.select("act", "location", F.col("text").alias("new")), ["act", "location"], "left")
    return shown.select("act", "location", "change_type", signals.explainable(F.col("change_type"), F.col("old"), F.col("new"), 2000).alias("explainable"))


@query(
    """WITH f AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS k, l_suppkey FROM lineitem), p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_suppkey, l_linenumber) AS k, l_quantity FROM lineitem)
SELECT f.l_orderkey, count(*) AS n_filed, sum(p.l_quantity) AS quantity FROM f JOIN p USING (l_orderkey, l_partkey, k) GROUP BY 1"""
)
def index_payload_join(spark, sf_dir):
    """Index rows meet payload rows by key and occurrence."""
    items = table(spark, sf_dir, "lineitem")
    filed = pairing.numbered(items, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey"]).select("l_orderkey", "l_partkey", "occurrence")
    payload = pairing.numbered(items, ["l_orderkey", "l_partkey"], ["l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "occurrence", "l_quantity")
    return filed.join(payload, ["l_orderkey", "l_partkey", "occurrence"]).groupBy("l_orderkey").agg(F.count("*").alias("n_filed"), F.sum("l_quantity").alias("quantity"))


@query("SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n_events, newest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate)::DATE AS newest FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def catalogue_join(spark, sf_dir):
    index = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).alias("newest"))
    return table(spark, sf_dir, "customer").join(index, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n_events"), "newest")


@query("SELECT DISTINCT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def substance_semi_join(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(hits, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("SELECT p.p_partkey, max(o.o_orderdate)::DATE AS stamp, count(DISTINCT o.o_orderkey) AS n_events, count(DISTINCT c.c_custkey) AS n_acts FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'MACHINERY' GROUP BY 1")
def entry_stamps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    acts = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("act"))
    joined = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").join(orders, "l_orderkey").join(acts, "o_custkey", "left")
    known = joined.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return known.groupBy("p_partkey").agg(F.max(F.to_date("o_orderdate")).alias("stamp"), F.countDistinct("l_orderkey").alias("n_events"), F.countDistinct("act").alias("n_acts"))


@query("SELECT DISTINCT l.l_orderkey, l.l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'R' AND m.l_orderkey = l.l_orderkey AND m.l_partkey % 7 = l.l_partkey % 7)")
def digest_inputs(spark, sf_dir):
    """Changes that matches name by a key of two columns."""
    items = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 7)
    return items.join(items.where("l_returnflag = 'R'").select("l_orderkey", "k"), ["l_orderkey", "k"], "left_semi").select("l_orderkey", "l_partkey").distinct()


@query("SELECT DISTINCT user_id, strftime(ts, '%Y-%m') AS month FROM events WHERE event_type IN ('purchase', 'error')")
def activity_in_month(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "event_type")
    sides = [events.where(F.col("event_type") == k).select("user_id", "month") for k in ("purchase", "error")]
    return sides[0].unionByName(sides[1]).distinct()


@query(
    """WITH p AS (SELECT l_orderkey AS a, l_partkey + 1000000 AS b FROM lineitem WHERE l_linenumber = 1), f AS (SELECT a AS here, b AS there, TRUE AS forward FROM p UNION SELECT b, a, FALSE FROM p)
SELECT here, count(DISTINCT there) AS n_twins, bool_and(forward) AS first_side FROM f GROUP BY 1"""
)
def twin_index(spark, sf_dir):
    """Each pair of twins seen from both sides."""
    pairs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("here"), (F.col("l_partkey") + 1_000_000).alias("there"))
    both = pairs.withColumn("forward", F.lit(True)).unionByName(pairs.select(F.col("there").alias("here"), F.col("here").alias("there"), F.lit(False).alias("forward")))
    return both.groupBy("here").agg(F.countDistinct("there").alias("n_twins"), F.bool_and("forward").alias("first_side"))


@query(
    """WITH s AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS held FROM orders GROUP BY 1), k AS (SELECT held, count(*) AS n FROM s WHERE o_custkey % 2 = 1 GROUP BY 1)
SELECT s.o_custkey FROM s JOIN k ON k.held = s.held AND k.n = 1 WHERE s.o_custkey % 2 = 0"""
)
def canonical_page_dedupe(spark, sf_dir):
    """Pages of one kind whose set equals that of exactly one page of the other kind."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("held"))
    sole = held.where("o_custkey % 2 = 1").groupBy("held").agg(F.count("*").alias("n")).where("n = 1")
    return held.where("o_custkey % 2 = 0").join(sole, "held", "left_semi").select("o_custkey")


@query("SELECT coalesce(n.n_nationkey, s.s_nationkey) AS nation, n.n_name, coalesce(s.k, 0) AS n_suppliers, n.n_regionkey IS NULL AS unlisted FROM (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n FULL JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey")
def roster_join(spark, sf_dir):
    """A watchlist and what is recorded, either side whole."""
    listed = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("nation"), "n_name", "n_regionkey")
    held = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("k"))
    return listed.join(held, "nation", "full").select("nation", "n_name", F.coalesce("k", F.lit(0)).alias("n_suppliers"), F.col("n_regionkey").isNull().alias("unlisted"))


@query("WITH b AS (SELECT item_id, sha256(text) AS h FROM benchmark), j AS (SELECT sha256(text) AS h, item_id % 3 AS verdict FROM benchmark WHERE item_id % 4 <> 3) SELECT b.item_id, min(verdict)::INT AS verdict, count(DISTINCT verdict) > 1 AS ambiguous FROM b LEFT JOIN j USING (h) GROUP BY 1")
def benchmark_join(spark, sf_dir):
    """Verdicts meet labels by the digest of what was judged; two verdicts on one digest are ambiguous."""
    items = table(spark, sf_dir, "benchmark").withColumn("h", digest(F.col("text")))
    verdicts = items.where("item_id % 4 <> 3").groupBy("h").agg(F.min(F.col("item_id") % 3).cast("int").alias("verdict"), F.countDistinct(F.col("item_id") % 3).alias("k"))
    return items.join(verdicts, "h", "left").select("item_id", "verdict", F.coalesce(F.col("k") > 1, F.lit(False)).alias("ambiguous"))


@query(
    f"""WITH {DELTA_SQL}, kept AS (SELECT doc_id AS location, quality, toxic FROM labels), m AS (SELECT d.act, d.location, d.change_type, k.quality, k.toxic FROM delta d LEFT JOIN (SELECT location, max(quality) AS quality, max(toxic) AS toxic FROM kept GROUP BY 1) k ON k.location = d.location)
SELECT act, location, change_type, CASE WHEN quality IS NULL THEN 'new' WHEN change_type = 'unchanged' THEN 'stale' ELSE 'carried' END AS repair FROM m"""
)
def repair_merge(spark, sf_dir):
    """A re-derived delta merged with the signals that the record holds: what is carried, new, or no longer there."""
    from ..operators import versions

    delta = versions.diff_units(fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir)).select("act", "location", "change_type")
    held = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("location")).agg(F.max("quality").alias("quality"))
    repair = F.when(F.col("quality").isNull(), "new").when(F.col("change_type") == "unchanged", "stale").otherwise("carried")
    return delta.join(held, "location", "left").select("act", "location", "change_type", repair.alias("repair"))


@query(
    f"""WITH {DELTA_SQL}, p AS (SELECT location, CASE WHEN change_type = 'unchanged' THEN 'kept' WHEN change_type = 'deleted' THEN 'withdrawn' WHEN location % 3 = 0 THEN 'asked' ELSE 'carried' END AS part FROM delta)
SELECT part, count(*) AS n, count(*) = count(DISTINCT location) AS disjoint FROM p GROUP BY 1"""
)
def delta_partition_check(spark, sf_dir):
    """Four parts that cover a delta, none of which has a unit twice."""
    from ..operators import versions

    delta = versions.diff_units(fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir))
    part = F.when(F.col("change_type") == "unchanged", "kept").when(F.col("change_type") == "deleted", "withdrawn").when(F.col("location") % 3 == 0, "asked").otherwise("carried")
    return delta.groupBy(part.alias("part")).agg(F.count("*").alias("n"), (F.count("*") == F.countDistinct("location")).alias("disjoint"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey), list(l_suppkey)))), ',') AS ids FROM lineitem GROUP BY 1")
def identifier_set(spark, sf_dir):
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p"), F.collect_set("l_suppkey").alias("s"))
    return sides.select("l_orderkey", F.array_join(F.array_sort(F.array_union("p", "s")), ",").alias("ids"))


@query("SELECT l_orderkey, l_suppkey, min(l_shipdate)::DATE AS written, min(CASE WHEN l_returnflag = 'R' THEN 'old' ELSE 'new' END) AS origin FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_returnflag = 'R' DESC) AS k FROM lineitem) WHERE k = 1 GROUP BY 1, 2")
def insert_matches(spark, sf_dir):
    """Rows written unless their key is there already; of one batch the first counts."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_returnflag")
    first = lambda rows, origin: rows.groupBy("l_orderkey", "l_suppkey").agg(F.min("d").alias("written")).withColumn("origin", F.lit(origin))
    there = first(items.where("l_returnflag = 'R'"), "old")
    new = first(items.where("l_returnflag <> 'R'"), "new").join(there, ["l_orderkey", "l_suppkey"], "left_anti")
    return there.unionByName(new).select("l_orderkey", "l_suppkey", "written", "origin")


@query("WITH m AS (SELECT user_id, event_id, event_type = 'purchase' AS free FROM events), d AS (SELECT user_id, count(*) FILTER (free) AS n FROM m GROUP BY 1) SELECT m.event_id, CASE WHEN m.free THEN 'delivery-' || m.user_id END AS delivery, d.n > 0 AS kept FROM m JOIN d USING (user_id)")
def assign_deliveries(spark, sf_dir):
    """Matches without a delivery get their watcher's; a delivery that gets none is dropped."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("free"))
    held = events.groupBy("user_id").agg(F.bool_or("free").alias("kept"))
    return events.join(held, "user_id").select("event_id", F.when(F.col("free"), F.concat(F.lit("delivery-"), F.col("user_id").cast("string"))).alias("delivery"), "kept")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN url || '#new' ELSE url END AS url, page_id % 3 <> 2 AS updated FROM pages")
def refresh_urls(spark, sf_dir):
    """Addresses updated where the new one is another, null safe."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    new = pages.select("page_id", F.when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("#new"))).when(F.col("page_id") % 3 == 2, F.col("url")).alias("fresh"))
    changed = ~F.col("url").eqNullSafe(F.col("fresh"))
    return pages.join(new, "page_id").select("page_id", F.when(changed, F.col("fresh")).otherwise(F.col("url")).alias("url"), changed.alias("updated"))


@query(
    f"""WITH {DELTA_SQL}, m AS (SELECT DISTINCT old_digest, new_digest, location % 2 = 0 AS early FROM delta WHERE change_type = 'modified'), k AS (SELECT old_digest, new_digest, bool_or(early) AS early FROM m GROUP BY ALL)
SELECT count(*) AS n_stored, count(*) FILTER (early) AS computed_first, count(*) FILTER (NOT early) AS computed_then, count(*) FILTER (early) AS reused_then, 0 AS computed_last FROM k"""
)
def comparison_memo(spark, sf_dir):
    """A store of word differences, filled by three runs: over half of the pairs, over all, and over all again."""
    from . import texts as plan

    base = f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}"
    held = staged(plan.modified_texts(spark, sf_dir).select("location", comparison_text(F.col("old")).alias("before"), comparison_text(F.col("new")).alias("after")))

    def run(pairs):
        return memo.refreshed(spark, base, pairs.select("before", "after"), "words-1", lambda missing: missing.select("key", similarity.diff_spans("before", "after").alias("spans")))

    _, first, _ = run(held.where("location % 2 = 0"))
    _, then, reused = run(held)
    store, last, _ = run(held)
    counts = {"computed_first": first, "computed_then": then, "reused_then": reused}
    return store.agg(F.count("*").alias("n_stored"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()], F.lit(last).alias("computed_last"))


@query("SELECT l_partkey, max(l_shipdate)::DATE AS version, count(*) FILTER (l_shipdate = newest) AS n_entries FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_partkey) AS newest FROM lineitem) GROUP BY 1")
def latest_register(spark, sf_dir):
    """Entries of a register's newest version; older ones are refused."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("version")).agg(F.count("*").alias("n"))
    return days.groupBy("l_partkey").agg(F.max("version").alias("version"), F.max_by("n", "version").alias("n_entries"))


@query(f"WITH {DELTA_SQL} SELECT n.act, count(*) AS n_missing FROM n LEFT JOIN o ON o.act = n.act AND o.location = n.location AND o.digest = n.digest WHERE o.act IS NULL GROUP BY 1")
def store_missing(spark, sf_dir):
    """Texts that a store lacks: what a writer has to add."""
    def listing(version):
        return version.select("act", "location", digest(comparison_text(F.col("text"))).alias("digest"))

    missing = listing(fixtures.after(spark, sf_dir)).join(listing(fixtures.before(spark, sf_dir)), ["act", "location", "digest"], "left_anti")
    return missing.groupBy("act").agg(F.count("*").alias("n_missing"))
