"""Queries on locations, dates, identifiers and other scalar readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identifiers, keys, locations, references
from ..functions.text import comparison_text, digest, rounded
from ..operators import entries
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_C = r"trim(regexp_replace({t}, '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Raw locations of customers, eight forms: a numbered annex, a dotted article with a path, a stray token, a chapter, annexes
#: as a whole, points and indents, a section's text, and an unknown code.
_RAW_SQL = """raw AS (SELECT c_custkey AS id, c_custkey % 8 AS f, c_custkey // 8 AS k, c_nationkey AS n FROM customer),
norm AS (SELECT *, CASE f WHEN 0 THEN 'AN ' || (id % 60) WHEN 1 THEN 'AR ' || k || '.2' WHEN 3 THEN 'CHA ' || n WHEN 4 THEN 'AN' WHEN 7 THEN 'XYZ ' || k ELSE 'AR ' || k END AS head,
  CASE f WHEN 1 THEN ' PA ' || n || ' ALN PTA (bb)' WHEN 2 THEN ' .20 PO B)' WHEN 5 THEN ' PO ' || n || ' TIRE 1' WHEN 6 THEN ' SECTION ' || n || ' TEXT' WHEN 7 THEN ' PA ' || n ELSE '' END AS tail FROM raw)"""


def _raw(spark, sf_dir):
    i, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    k = F.floor(i / 8).cast("string")
    forms = {
        0: F.concat(F.lit("{AN|http://x/AN}  "), (i % 60).cast("string")),
        1: F.concat(F.lit("{AR|http://x/AR} "), k, F.lit(".2   {PA|http://x/PA} "), n, F.lit(" {ALN|http://x/ALN} PTA (bb)")),
        2: F.concat(F.lit(" AR "), k, F.lit(" .20 PO B)")),
        3: F.concat(F.lit("CHA "), n),
        4: F.lit("{AN|http://x/AN}"),
        5: F.concat(F.lit("AR "), k, F.lit(" {PO|http://x/PO} "), n, F.lit(" TIRE 1")),
        6: F.concat(F.lit("AR "), k, F.lit(" SECTION "), n, F.lit(" TEXT ")),
        7: F.concat(F.lit("XYZ "), k, F.lit(" PA "), n),
    }
    raw = F.coalesce(*[F.when(i % 8 == f, form) for f, form in forms.items()])
    return table(spark, sf_dir, "customer").select(i.alias("id"), "c_nationkey", raw.alias("raw")).withColumn("parsed", locations.segments(F.col("raw")))


@query(f"WITH {_RAW_SQL} SELECT id, head || tail AS location, [1, 4, 3, 1, 1, 3, 3, 2][f + 1] AS n_segments FROM norm")
def location_parse(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", locations.written(F.col("parsed")).alias("location"), F.size("parsed").alias("n_segments"))


@query(f"WITH {_RAW_SQL} SELECT head AS unit, count(*) AS n FROM norm GROUP BY 1")
def unit_projection(spark, sf_dir):
    return _raw(spark, sf_dir).groupBy(locations.top_level(F.col("parsed")).alias("unit")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_RAW_SQL} SELECT id, row_number() OVER (ORDER BY [1, 0, 0, 2, 1, 0, 0, 3][f + 1], CASE f WHEN 0 THEN id % 60 WHEN 3 THEN n WHEN 4 THEN -1 ELSE k END,
  CASE f WHEN 6 THEN 0 WHEN 5 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 0 END, id) AS ord FROM norm"""
)
def location_sort_order(spark, sf_dir):
    from ..operators.ranking import ranked

    keyed = _raw(spark, sf_dir).select("id", locations.sort_key(F.col("parsed")).alias("key"))
    return ranked(keyed, ["key", "id"], "ord").select("id", "ord")


@query(
    f"""WITH {_RAW_SQL} SELECT id, CASE f WHEN 0 THEN 'Annex ' || (id % 60) WHEN 1 THEN 'Art. ' || k || '.2(' || n || ') ALN(bb)' WHEN 2 THEN 'Art. ' || k || ' .20(B))'
  WHEN 3 THEN 'CHA ' || n WHEN 4 THEN 'Annex' WHEN 5 THEN 'Art. ' || k || '(' || n || ')(1)' WHEN 6 THEN 'Art. ' || k || ' section ' || n || ' text' ELSE 'XYZ ' || k || '(' || n || ')' END AS human FROM norm"""
)
def location_human(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", locations.human(F.col("parsed")).alias("human"))


@query(
    f"""WITH {_RAW_SQL}, g AS (SELECT *, CASE WHEN f IN (3, 4) THEN 'container' WHEN f = 0 AND id % 60 NOT BETWEEN 1 AND 50 THEN 'unconverted' END AS gap FROM norm)
SELECT id, CASE WHEN gap IS NULL THEN CASE f WHEN 0 THEN 'AN ' || ['', 'X', 'XX', 'XXX', 'XL', 'L'][id % 60 // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][id % 10 + 1]
  WHEN 1 THEN 'AR ' || k || tail ELSE head || tail END END AS code, gap FROM g"""
)
def unit_code_gaps(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", locations.unit_code(F.col("raw")).alias("u")).select("id", "u.code", "u.gap")


@query(
    f"""WITH {_RAW_SQL} SELECT n AS c_nationkey, arg_min(id, ([0, 0, 0, 2, 0, 0, 0, 2][f + 1] + CASE WHEN f IN (0, 4) THEN 1 ELSE 0 END,
  CASE f WHEN 0 THEN id % 60 WHEN 3 THEN n WHEN 4 THEN -1 ELSE k END, f = 1, id)) AS first_id FROM norm GROUP BY 1"""
)
def digest_location_order(spark, sf_dir):
    rows = _raw(spark, sf_dir).select("id", "c_nationkey", locations.digest_order(F.slice("parsed", 1, 1)).alias("key"))
    return rows.groupBy("c_nationkey").agg(F.min_by("id", F.struct("key", "id")).alias("first_id"))


_DAYS_SQL = "days AS (SELECT o_orderkey, o_orderkey % 6 AS f, o_orderdate::DATE AS day FROM orders)"


@query(f"WITH {_DAYS_SQL} SELECT o_orderkey, CASE WHEN f IN (0, 1) THEN day END AS iso, CASE WHEN f = 2 THEN day END AS compact FROM days")
def date_decoders(spark, sf_dir):
    """Dates as notices and as attributes write them; other spellings and days that don't exist are unreadable."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    spelt = {0: "yyyy-MM-dd", 1: " yyyy/MM/dd ", 2: "yyyyMMdd", 3: "yyyy-'13'-dd", 4: "dd/MM/yyyy"}
    raw = F.coalesce(*[F.when(k == f, F.date_format(d, p)) for f, p in spelt.items()])
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso(raw).alias("iso"), dates.compact(raw).alias("compact"))


_DATED_SQL = """dated AS (SELECT doc_id, text || ' applies from ' || strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') || CASE WHEN doc_id % 4 = 0 THEN ', not 2024-99-01.' ELSE '.' END AS t FROM documents)"""


def _dated(spark, sf_dir):
    i = F.col("doc_id")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (i % 365).cast("int")).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" applies from "), day, F.when(i % 4 == 0, F.lit(", not 2024-99-01.")).otherwise(F.lit("."))).alias("t"))


@query(
    rf"""WITH {_DATED_SQL}, m AS (SELECT doc_id, t, regexp_extract_all(t, '\d{{4}}-\d{{2}}-\d{{2}}') AS ms FROM dated)
SELECT doc_id, len(ms)::INT AS n_mentions, len(list_filter(ms, lambda x: try_cast(x AS DATE) IS NULL))::INT AS n_failed,
sha256({_C.format(t="substr(t, greatest(1, instr(t, ms[1]) - 115), 240)")}) AS context FROM m"""
)
def date_mentions(spark, sf_dir):
    m = _dated(spark, sf_dir).withColumn("ms", dates.mentions(F.col("t")))
    context = F.substring(F.col("t"), F.greatest(F.lit(1), F.instr("t", F.col("ms")[0]) - 115), F.lit(240))
    return m.select("doc_id", F.size("ms").alias("n_mentions"), F.size(F.filter("ms", lambda x: x.try_cast("date").isNull())).alias("n_failed"), digest(comparison_text(context)).alias("context"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE WHEN ship IS NOT NULL THEN ship WHEN o_orderkey % 10 <> 0 THEN DATE '1999-01-01' END AS day,
CASE WHEN o_orderstatus = 'F' THEN 'stated' WHEN ship IS NOT NULL THEN 'deferred' WHEN o_orderkey % 10 <> 0 THEN 'default' ELSE 'none' END AS tier
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate)::DATE AS ship FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def effect_date_tiers(spark, sf_dir):
    ship = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.to_date("l_shipdate")).alias("ship"))
    stated = F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))
    default = F.when(F.col("o_orderkey") % 10 != 0, F.to_date(F.lit("1999-01-01")))
    return table(spark, sf_dir, "orders").join(ship, "o_orderkey", "left").select("o_orderkey", dates.effect_date(stated, F.col("ship"), default).alias("e")).select("o_orderkey", "e.day", "e.tier")


@query(
    """SELECT l_orderkey, CASE WHEN bool_or(l_quantity > 49 OR l_linestatus NOT IN ('O', 'F')) THEN NULL WHEN count(DISTINCT l_shipdate) FILTER (l_returnflag = 'A') = 1 THEN min(l_shipdate::DATE) FILTER (l_returnflag = 'A')
WHEN count(DISTINCT l_shipdate) FILTER (l_returnflag = 'A') = 0 AND count(DISTINCT l_shipdate) FILTER (l_returnflag = 'R') = 1 THEN min(l_shipdate::DATE) FILTER (l_returnflag = 'R') END AS day FROM lineitem GROUP BY 1"""
)
def notice_date_fallback(spark, sf_dir):
    """The sole application date, else the sole date of entry into force; withheld if any entry is implausible or of unknown kind."""
    items = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    kinds = {k: F.collect_set(F.when(F.col("l_returnflag") == k, F.col("d"))).alias(k) for k in ("A", "R")}
    sides = items.groupBy("l_orderkey").agg(F.bool_or((F.col("l_quantity") > 49) | ~F.col("l_linestatus").isin("O", "F")).alias("withheld"), *kinds.values())
    sole = F.when(F.size("A") == 1, F.col("A")[0]).when((F.size("A") == 0) & (F.size("R") == 1), F.col("R")[0])
    return sides.select("l_orderkey", F.when(~F.col("withheld"), sole).alias("day"))


@query("SELECT event_id, strftime(coalesce(CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 2 DAY END, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 HOUR END, TIMESTAMP '2024-03-01' - INTERVAL 14 DAY), '%Y-%m-%d %H:%M:%S') AS starts FROM events")
def poll_window_start(spark, sf_dir):
    flag = F.when(F.col("event_id") % 7 == 0, F.col("ts") - F.expr("INTERVAL 2 DAYS"))
    start = dates.window_start(flag, F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.lit("2024-03-01").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("starts"))


@query(rf"SELECT doc_id, sha256(regexp_replace(strip_accents(translate({_C.format(t='text')}, '‐‑‒–−', '-----')), ' ', '', 'g') || 'm2-fi-oc') AS plain FROM documents")
def typography_fold(spark, sf_dir):
    """Texts and a few letters beyond Latin-1, folded."""
    marked = F.concat("text", F.lit(" m² − ﬁ‑ő č"))
    return table(spark, sf_dir, "documents").select("doc_id", digest(entries.folded(marked)).alias("plain"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_brand || ': ' || p_name || ' of ' || p_type || ' ' || p_name, split_part(p_name, ' ', 1), ''), split_part(p_name, ' ', 2), '') AS rest FROM part")
def residual_text(spark, sf_dir):
    """What a node's text has beside its children's: the first occurrence of each child is taken out, in order."""
    whole = F.concat_ws("", "p_brand", F.lit(": "), "p_name", F.lit(" of "), "p_type", F.lit(" "), "p_name")

    def without(text, child):
        at = F.instr(text, child)
        return F.when((at > 0) & (child != ""), F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.char_length(child), F.char_length(text)))).otherwise(text)

    children = F.slice(F.split("p_name", " "), 1, 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(children, whole, without).alias("rest"))


@query(
    r"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS f, o_custkey % 100 + 1 AS n, o_orderkey % 9 + 1 AS p FROM orders), u AS (SELECT *, CASE f WHEN 5 THEN 'AN IV' ELSE 'AR ' || n || ' PA 1' END AS unit, 'AR ' || n || ' PA ' AS own FROM o)
SELECT o_orderkey, unit, CASE f WHEN 0 THEN own || p WHEN 1 THEN list_aggregate(list_sort(list_distinct([own || p, own || p || 'a', own || '12 PTA (e)'])), 'string_agg', ';') WHEN 2 THEN own || p || ' PTA (a)' WHEN 4 THEN own || '9' ELSE '' END AS named FROM u"""
)
def coordinate_mentions(spark, sf_dir):
    """Paragraphs and points of its own article that a sentence names; those of other acts and articles don't count."""
    i, n, p = F.col("o_orderkey"), (F.col("o_custkey") % 100 + 1).cast("string"), (F.col("o_orderkey") % 9 + 1).cast("string")
    said = {
        0: F.concat(F.lit("It amends paragraph "), p, F.lit(" only.")),
        1: F.concat(F.lit("Paragraphs "), p, F.lit(", "), p, F.lit("A and 12(e) change, paragraph 3 of Article 10 does not.")),
        2: F.concat(F.lit("See article "), n, F.lit(" ("), p, F.lit(")(a), Article "), n, F.lit("(7) of Directive 1 and Article "), F.concat(n, F.lit("1(2)."))),
        3: F.lit("Paragraph X and Article 5000(1) are none."),
        4: F.lit("The point in paragraph 9(1) is unclear."),
        5: F.concat(F.lit("paragraph "), p),
    }
    sentence = F.coalesce(*[F.when(i % 6 == f, s) for f, s in said.items()])
    unit = F.when(i % 6 == 5, F.lit("AN IV")).otherwise(F.concat(F.lit("AR "), n, F.lit(" PA 1")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", sentence.alias("s"), unit.alias("unit"))
    return rows.select("o_orderkey", "unit", F.array_join(references.coordinates(F.col("s"), F.col("unit")), ";").alias("named"))


@query(
    r"""WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS f, p_partkey // 8 % 40 + 1 AS k, p_size AS z FROM part)
SELECT id, CASE f WHEN 0 THEN 'AR ' || k || ' PA ' || z || ' PTA (g)' WHEN 1 THEN 'AN IX SCT 5.1 PTA (h)' WHEN 2 THEN 'AR 5 PA ' || k || ' ALN 1' WHEN 3 THEN 'AR 5 PO ' || k WHEN 4 THEN 'AN XIV PRT C SCT 6.6.2' WHEN 5 THEN 'AR ' || k || 'a TIT' WHEN 6 THEN 'AR 5' WHEN 7 THEN 'AR 5 PA 2 TIRE 3' END AS location FROM p"""
)
def reference_grammar(spark, sf_dir):
    """Clauses of amending acts, read inside Article 5."""
    i, k, z = F.col("p_partkey"), (F.floor(F.col("p_partkey") / 8) % 40 + 1).cast("string"), F.col("p_size").cast("string")
    said = {
        0: F.concat(F.lit("in Article "), k, F.lit("("), z, F.lit("), point (g) is replaced")),
        1: F.lit("in point (h) of Section 5.1 of Annex IX, the words are deleted"),
        2: F.concat(F.lit("in paragraph "), k, F.lit(", the first subparagraph is replaced")),
        3: F.concat(F.lit("points "), k, F.lit(" and 99 are deleted")),
        4: F.lit("in the introductory part of Part C, section 6.6.2. of annex xiv"),
        5: F.concat(F.lit("in Article "), k, F.lit("A the heading is replaced")),
        6: F.lit("the date 26 May 2020 is replaced by 26 May 2021"),
        7: F.lit("The second paragraph, the third indent, is deleted"),
    }
    clause = F.coalesce(*[F.when(i % 8 == f, s) for f, s in said.items()])
    rows = table(spark, sf_dir, "part").select(i.alias("id"), clause.alias("clause"))
    return rows.select("id", locations.written(references.resolved(F.col("clause"), locations.segments(F.lit("AR 5")))).alias("location"))


@query(
    r"""WITH s AS (SELECT p_partkey, lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '-' || (p_partkey % 10) AS cas, (200 + p_partkey % 800) || '-' || lpad((p_partkey // 7 % 1000)::VARCHAR, 3, '0') || '-' || (p_partkey % 11 % 10) AS ec,
  lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((p_partkey // 3 % 1000)::VARCHAR, 3, '0') || '-00-' || CASE WHEN p_partkey % 11 = 10 THEN 'X' ELSE (p_partkey % 11)::VARCHAR END AS idx FROM part),
d AS (SELECT *, ltrim(split_part(cas, '-', 1), '0') AS c1, replace(left(cas, length(cas) - 2), '-', '') AS cb, replace(left(ec, 7), '-', '') AS eb, replace(left(idx, 10), '-', '') AS ib FROM s),
v AS (SELECT *, length(c1) >= 2 AND list_sum(list_transform(range(1, length(cb) + 1), lambda i: i * substr(cb, length(cb) - i + 1, 1)::INT)) % 10 = right(cas, 1)::INT AS cok,
  list_sum(list_transform(range(1, 7), lambda i: i * substr(eb, i, 1)::INT)) % 11 AS er, list_sum(list_transform(range(1, 9), lambda i: i * substr(ib, i, 1)::INT)) % 11 AS ir FROM d),
w AS (SELECT *, CASE er WHEN 10 THEN 1 ELSE er END = right(ec, 1)::INT AS eok, CASE ir WHEN 10 THEN 'X' ELSE ir::VARCHAR END = right(idx, 1) AS iok FROM v)
SELECT p_partkey, concat_ws(',', CASE WHEN cok THEN 'cas:' || c1 || '-' || split_part(cas, '-', 2) || '-' || right(cas, 1) END, CASE WHEN NOT (cok AND c1 || substr(cas, 4) = '50-00-0') THEN 'cas:50-00-0' END, CASE WHEN eok THEN 'ec:' || ec END, CASE WHEN iok THEN 'index:' || idx END) AS found,
  ((NOT cok)::INT + (NOT eok)::INT + (NOT iok)::INT)::INT AS failed FROM w"""
)
def identifier_extraction(spark, sf_dir):
    """Numbers of three schemes in a cell, each once in its canonical form, and how many fail their check."""
    k = F.col("p_partkey")

    def padded(value, n: int):
        return F.lpad(value.cast("long").cast("string"), n, "0")

    cas = F.concat_ws("-", padded(k % 1000, 3), padded(k % 100, 2), (k % 10).cast("string"))
    ec = F.concat_ws("-", (200 + k % 800).cast("string"), padded(F.floor(k / 7) % 1000, 3), (k % 11 % 10).cast("string"))
    index = F.concat_ws("-", padded(k % 1000, 3), padded(F.floor(k / 3) % 1000, 3), F.lit("00"), F.when(k % 11 == 10, F.lit("X")).otherwise((k % 11).cast("string")))
    cell = F.concat_ws(" ", F.lit("x"), cas, F.lit("; 50‑00‑0, 50-00-0"), ec, F.lit("1234-567-89-0"), index)
    read = table(spark, sf_dir, "part").select(k, identifiers.in_cell(cell).alias("i"))
    return read.select("p_partkey", F.array_join(F.transform("i.found", lambda f: F.concat_ws(":", f["scheme"], f["value"])), ",").alias("found"), "i.failed")


_ACTS_SQL = "a AS (SELECT c_custkey AS id, c_custkey % 8 AS f, (1990 + c_nationkey) || 'R' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS code FROM customer)"


def _acts(spark, sf_dir):
    i = F.col("c_custkey")
    code = F.concat((1990 + F.col("c_nationkey")).cast("string"), F.lit("R"), F.lpad((i % 10_000).cast("string"), 4, "0"))
    raw = {
        0: F.concat(F.lit("3"), code),
        1: F.concat(F.lit("celex:3"), F.lower(code)),
        2: F.concat(F.lit(" 0"), code, F.lit("-20260727 ")),
        3: F.concat(F.lit("consolidation:"), code, F.lit("/20260727_0010010")),
        4: F.concat(F.lit("eli:reg:"), code),
        5: F.concat(F.lit("oj:L_"), code),
        6: F.concat(F.lit("celex:0"), code, F.lit("-20261327")),
        7: F.concat(F.lit("consolidation:"), code, F.lit("/20240229")),
    }
    return table(spark, sf_dir, "customer").select(i.alias("id"), F.coalesce(*[F.when(i % 8 == f, r) for f, r in raw.items()]).alias("raw"))


@query(f"WITH {_ACTS_SQL} SELECT id, CASE WHEN f IN (0, 1) THEN 'celex' WHEN f IN (2, 3, 7) THEN 'consolidated' END AS form, CASE f WHEN 0 THEN '3' || code WHEN 1 THEN '3' || code WHEN 7 THEN '0' || code || '-20240229' WHEN 2 THEN '0' || code || '-20260727' WHEN 3 THEN '0' || code || '-20260727' END AS value, CASE f WHEN 7 THEN DATE '2024-02-29' WHEN 2 THEN DATE '2026-07-27' WHEN 3 THEN DATE '2026-07-27' END AS day FROM a")
def identifier_grammar(spark, sf_dir):
    """Identifiers of acts and versions in their spellings; other families and impossible days aren't read."""
    return _acts(spark, sf_dir).select("id", identifiers.act_identifier(F.col("raw")).alias("x")).select("id", "x.form", "x.value", "x.day")


@query(f"WITH {_ACTS_SQL} SELECT id, CASE WHEN f IN (0, 2) THEN FALSE ELSE f IN (1, 3, 6, 7) END AS readable FROM a")
def feed_readable(spark, sf_dir):
    """Whether an entry's identifier is of a family that can be read."""
    scheme = F.when(F.col("raw").contains(":"), F.split_part("raw", F.lit(":"), F.lit(1)))
    return _acts(spark, sf_dir).select("id", F.coalesce(identifiers.readable(scheme), F.lit(False)).alias("readable"))


@query(
    f"""WITH {_RAW_SQL} SELECT id, 'https://eur-lex.europa.eu/legal-content/EN/TXT/HTML/?uri=CELEX:32024R' || lpad((id % 10000)::VARCHAR, 4, '0') || CASE WHEN f = 0 THEN '#anx_' || (id % 60) WHEN f IN (1, 2, 5, 6) THEN '#art_' || k ELSE '' END AS url FROM norm"""
)
def citation_url(spark, sf_dir):
    """Pages of versions at the anchor of a location's unit; a chapter, all annexes and an unknown code have none."""
    version = F.concat(F.lit("32024R"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0"))
    return _raw(spark, sf_dir).select("id", references.citation_url(version, F.col("raw")).alias("url"))


@query("WITH n AS (SELECT doc_id, trim(split_part(trim(regexp_replace(text, '\\s+', ' ', 'g')), ';', 1)) AS s FROM documents), c AS (SELECT doc_id, s, regexp_extract(substr(s, 1, 61), '^(.*) ', 1) AS w FROM n) SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE regexp_replace(CASE WHEN w = '' THEN substr(s, 1, 60) ELSE w END, '[ ,]+$', '') || '…' END AS name FROM c")
def row_name_cut(spark, sf_dir):
    """A row's name: up to a semicolon, then whole words of at most 60 characters, with dots."""
    return table(spark, sf_dir, "documents").select("doc_id", keys.row_name(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("name"))


@query(
    r"""WITH p AS (SELECT p_partkey AS id, p_partkey % 9 AS f, lpad((p_partkey % 1000)::VARCHAR, 3, '0') || lpad((p_partkey // 3 % 1000)::VARCHAR, 3, '0') || '00' AS b, p_name AS n, p_partkey AS k FROM part),
c AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: i * substr(b, i, 1)::INT)) % 11 AS r FROM p), x AS (SELECT *, substr(b, 1, 3) || '-' || substr(b, 4, 3) || '-00-' || CASE r WHEN 10 THEN 'X' ELSE r::VARCHAR END AS idx FROM c)
SELECT id, CASE f WHEN 0 THEN idx WHEN 2 THEN k || 'a' WHEN 3 THEN 'x ' || n WHEN 4 THEN n || ' b' WHEN 5 THEN lower(n) WHEN 6 THEN '(+)-' || lower(n) WHEN 8 THEN k::VARCHAR END AS key, f = 1 AS failed FROM x"""
)
def key_readers(spark, sf_dir):
    """Keys of table rows in the four forms that profiles name."""
    i, n = F.col("p_partkey"), F.col("p_name")
    body = F.concat(F.lpad((i % 1000).cast("string"), 3, "0"), F.lpad((F.floor(i / 3) % 1000).cast("string"), 3, "0"), F.lit("00"))
    stem = F.concat(F.substring(body, 1, 3), F.lit("‑"), F.substring(body, 4, 3), F.lit("-00-"))
    right, wrong = identifiers.index_check(body), F.when(identifiers.index_check(body) == "X", F.lit("0")).otherwise(F.lit("X"))
    cells = {
        0: ("index", F.concat(stem, right, F.lit(" (note 1)"))),
        1: ("index", F.concat(stem, wrong)),
        2: ("number", F.concat(i.cast("string"), F.lit("a. "), n)),
        3: ("number", F.concat(F.lit("x  "), n)),
        4: ("text", F.concat(n, F.lit(" \n b"))),
        5: ("name", F.concat(F.initcap(n), F.lit(" (#)\n(C6H6)"))),
        6: ("name", F.concat(F.lit("(+)-"), F.initcap(n), F.lit(" **"))),
        7: ("name", F.lit(" — ")),
        8: ("number", i.cast("string")),
    }
    form = F.coalesce(*[F.when(i % 9 == f, F.lit(kind)) for f, (kind, _) in cells.items()])
    cell = F.coalesce(*[F.when(i % 9 == f, c) for f, (_, c) in cells.items()])
    rows = table(spark, sf_dir, "part").select(i.alias("id"), form.alias("form"), cell.alias("cell"))
    return rows.select("id", keys.read_key(F.col("cell"), F.col("form")).alias("r")).select("id", "r.key", "r.failed")


#: Fixed value: the blanks that end no line: every space of Unicode, as DuckDB's ``trim`` has them.
BLANKS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@query(r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, CASE WHEN length(ls[2]) BETWEEN 1 AND 200 AND NOT regexp_matches(ls[2], '^[0-9]') THEN ls[2] END AS subject FROM l")
def annex_subject(spark, sf_dir):
    """The second line of a text, if it is short and isn't a number."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    second = F.try_element_at(lines, F.lit(2))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length(second).between(1, 200) & ~second.rlike("^[0-9]"), second).alias("subject"))


@query("SELECT n.doc_id, round(length(text) / 2.25, 6) AS tokens_in, round(length(text) / 2.25 * 3e-6 + 351 * 15e-6, 9) AS cost FROM documents n")
def cost_model(spark, sf_dir):
    tokens = F.char_length("text") / F.lit(2.25)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tokens, 6).alias("tokens_in"), F.round(tokens * 3e-6 + 351 * 15e-6, 9).alias("cost"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_discount * 12.345, 3) AS ratio FROM lineitem")
def ratio_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(F.col("l_discount") * 12.345).alias("ratio"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn, role, text), ',') AS roles, sum(length(text)) AS n_chars FROM conversations GROUP BY 1")
def array_columns(spark, sf_dir):
    """Turns of a conversation as one list in record order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join("t.role", ",").alias("roles"), F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + F.char_length(t["text"])).alias("n_chars"))


@query("""SELECT conv_id, '[' || string_agg('{"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn, role) || ']' AS body, bool_or(text IS NULL OR text = '') AS noted FROM conversations GROUP BY 1""")
def sentences_to_json(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.bool_or(F.col("text").isNull() | (F.col("text") == "")).alias("noted"))
    return turns.select("conv_id", F.to_json(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["turn"].alias("turn")))).alias("body"), "noted")
