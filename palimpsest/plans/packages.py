"""Queries from packages of markup to documents, tables, entries and their differences.

Each customer with orders has two packages, one a version: an annex whose table holds the order lines, and a manifest. Some
archives are cut short. They are written by Spark from the tables and read by the same kernels as files are.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import entries
from ..operators.stages import staged
from ..sources import instructions, packages, provisions
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


#: The lines of both versions: a table's key is a part's number; the second version respaces, unaccents, amends or drops some.
_LINES_SQL = """items AS (SELECT o_custkey AS id, l_partkey % 50 AS key, l_returnflag || ' é ' || l_quantity::INT AS cell, l_linestatus AS mode,
  row_number() OVER (PARTITION BY o_custkey, l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
v AS (SELECT id, 1 AS version, key, k, cell, mode FROM items WHERE key % 10 <> 3
  UNION ALL SELECT id, 2, key, k, CASE key % 10 WHEN 1 THEN cell || ' ' WHEN 2 THEN replace(cell, 'é', 'e') WHEN 4 THEN cell || ' x' ELSE cell END, mode FROM items WHERE key % 10 <> 5 AND NOT (key % 10 = 6 AND k > 1)),
ids AS (SELECT DISTINCT id, version FROM v), kept AS (SELECT * FROM v WHERE id % 50 <> 7)"""


def _zipped(name: pd.Series, xml: pd.Series, cut: pd.Series) -> pd.Series:
    def one(n, x, short):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{n}.doc.xml", "<PUBLICATION/>")
            z.writestr(f"{n}.xml", x)
            z.writestr("readme.txt", n)
        return held.getvalue()[: -40 if short else None]

    return pd.Series([one(*r) for r in zip(name, xml, cut)])


def _packages(spark, sf_dir):
    """(key, content): two archives a customer."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, so few bytes aren't gathered into one task
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select(*order, "l_returnflag", F.col("l_quantity").cast("int").alias("l_quantity"), "l_linestatus").join(orders, "l_orderkey")
    items = items.where("id IS NOT NULL").repartition(parts, "id").withColumn("key", F.col("l_partkey") % 50)
    one_key = Window.partitionBy("id", "key")
    items = items.withColumns({"k": F.row_number().over(one_key.orderBy(*order)), "n": F.count("*").over(one_key)})
    # an order line stands in each version's array of its customer, so lines are grouped once
    kind, cell = F.col("key") % 10, F.concat_ws(" ", "l_returnflag", F.lit("é"), "l_quantity")
    edited = F.when(kind == 1, F.concat(cell, F.lit(" "))).when(kind == 2, F.replace(cell, F.lit("é"), F.lit("e"))).when(kind == 4, F.concat(cell, F.lit(" x"))).otherwise(cell)

    def version(cell, n):
        return F.struct("key", "k", cell.alias("cell"), F.col("l_linestatus").alias("mode"), n.alias("n"))

    # how many lines a key has stands in its first line's cell, as a row span
    old = F.when(kind != 3, version(cell, F.col("n")))
    new = F.when((kind != 5) & ~((kind == 6) & (F.col("k") > 1)), version(edited, F.when(kind == 6, F.lit(1).cast("long")).otherwise(F.col("n"))))
    held = items.groupBy("id").agg(*[F.array_sort(F.collect_list(lines)).alias(name) for name, lines in (("old", old), ("new", new))])
    held = held.select("id", F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("l")) for v, c in ((1, "old"), (2, "new"))]))).where(F.size("l") > 0)

    def cell_of(col: int, text, extra=F.lit("")):
        return F.concat(F.lit(f'<CELL COL="{col}"'), extra, F.lit(">"), text, F.lit("</CELL>"))

    def row(x):
        key = F.when(x["k"] == 1, cell_of(1, x["key"].cast("string"), F.concat(F.lit(' ROWSPAN="'), x["n"].cast("string"), F.lit('"')))).otherwise(F.lit(""))
        return F.concat(F.lit("<ROW>"), key, cell_of(2, x["cell"]), cell_of(3, x["mode"]), F.lit("</ROW>"))

    header = '<CELL COL="1">Key</CELL><CELL COL="2">Value</CELL><CELL COL="3">Mode</CELL></ROW>'
    start = f'<ANNEX><TITLE><TI>ANNEX II</TI></TITLE><CONTENTS><TBL COLS="3"><CORPUS><ROW TYPE="HEADER">{header}'
    end = f'<ROW>{header}<ROW><CELL COL="1"> </CELL></ROW></CORPUS></TBL></CONTENTS></ANNEX>'
    xml = F.concat(F.lit(start), F.array_join(F.transform("l", row), ""), F.lit(end))
    name = F.concat(F.lit("c"), F.col("id").cast("string"))
    written = held.select(F.concat_ws("/", "id", "version").alias("key"), name.alias("name"), xml.alias("xml"), (F.col("id") % 50 == 7).alias("cut"))
    return written.select("key", F.pandas_udf(_zipped, "binary")("name", "xml", "cut").alias("content"))


def _told(found):
    part = F.split("key", "/")
    return found.withColumns({"id": part[0].cast("long"), "version": part[1].cast("int")})


@query(
    f"""WITH {_LINES_SQL} SELECT id, version, 'damaged' AS state, NULL AS name FROM ids WHERE id % 50 = 7
UNION ALL SELECT id, version, 'read', unnest(['c' || id || '.doc.xml', 'c' || id || '.xml', 'readme.txt']) FROM ids WHERE id % 50 <> 7"""
)
def package_members(spark, sf_dir):
    """The members of every package; an archive that can't be read is told by its state."""
    return _told(packages.members(_packages(spark, sf_dir), "key")).select("id", "version", "state", "name")


@query(f"WITH {_LINES_SQL} SELECT id, version, 'c' || id || '.xml' AS name, 'annex' AS role FROM ids WHERE id % 50 <> 7")
def package_documents(spark, sf_dir):
    """The documents among the members: wrappers and other files are none."""
    return _told(packages.read_documents(_packages(spark, sf_dir), "key", data=False)).select("id", "version", "name", "role")


_PLACE = ["unit_name", "container", "table"]


def _lines(spark, sf_dir):
    docs = _told(packages.read_documents(_packages(spark, sf_dir), "key").where("role IN ('act', 'annex')"))
    lines = provisions.table_lines(docs, ["id", "version"])
    return lines.withColumn("unit_name", F.array_join(F.slice(F.split("container", " "), 1, 2), " "))


@query(
    f"""WITH {_LINES_SQL}, r AS (SELECT id, version, key, k, cell, mode, row_number() OVER (PARTITION BY id, version ORDER BY key, k) AS row FROM kept), n AS (SELECT id, version, max(row) AS n FROM r GROUP BY ALL),
l AS (SELECT id, version, row + 1 AS row, FALSE AS header, key || '|' || cell || '|' || mode AS cells, CASE WHEN k > 1 THEN 'R||' ELSE '||' END AS marks FROM r
  UNION ALL SELECT id, version, 1, TRUE, 'Key|Value|Mode', '||' FROM n UNION ALL SELECT id, version, n + 2, FALSE, 'Key|Value|Mode', '||' FROM n UNION ALL SELECT id, version, n + 3, FALSE, ' ||', '|-|-' FROM n)
SELECT id, version, 'AN II' AS container, 1 AS "table", row::INT AS row, header, cells, marks FROM l"""
)
def package_table_lines(spark, sf_dir):
    """Every line of every table as a grid, with how each place was filled."""
    return _lines(spark, sf_dir).select("id", "version", "container", "table", "row", "header", F.array_join("cells", "|").alias("cells"), F.array_join("marks", "|").alias("marks"))


@query(
    f"""WITH {_LINES_SQL}, e AS (SELECT id, version, key, string_agg(cell || '/' || mode, ';' ORDER BY k) AS value FROM kept GROUP BY ALL),
j AS (SELECT id, key, o.value AS ov, n.value AS nv FROM (SELECT * FROM e WHERE version = 1) o FULL JOIN (SELECT * FROM e WHERE version = 2) n USING (id, key)),
t AS (SELECT *, trim(regexp_replace(ov, '\\s+', ' ', 'g')) AS oc, trim(regexp_replace(nv, '\\s+', ' ', 'g')) AS nc FROM j)
SELECT id, key::VARCHAR AS key, CASE WHEN nv IS NULL THEN 'removed' WHEN ov IS NULL THEN 'added' WHEN ov = nv THEN 'unchanged' WHEN replace(oc, ' /', '/') = replace(nc, ' /', '/') THEN 'whitespace' ELSE 'amended' END AS change,
  coalesce(oc <> nc AND replace(oc, ' /', '/') <> replace(nc, ' /', '/') AND replace(strip_accents(ov), ' ', '') = replace(strip_accents(nv), ' ', ''), FALSE) AS typography_only FROM t"""
)
def package_entry_diff(spark, sf_dir):
    """From the markup of two versions to the difference of their tables' entries."""
    held = entries.of_lines(_lines(spark, sf_dir), ["id", "version", *_PLACE])
    value = F.array_join(F.transform("rows", lambda r: F.array_join(F.slice(r, 2, 2), " /")), " ;")
    shown = staged(held.select("id", "version", *_PLACE, "key", "occurrence", value.alias("value")))
    old, new = (shown.where(F.col("version") == v).drop("version") for v in (1, 2))
    return entries.difference(old, new, ["id", *_PLACE], "key", "value").select("id", "key", "change", "typography_only")


#: Amending acts: ten parts each, a point of a list for each part, in six forms.
_ACTS_SQL = """p AS (SELECT p_partkey // 10 AS id, p_partkey % 10 AS k, p_partkey % 6 AS f, p_size AS n, p_partkey % 9 + 1 AS q FROM part),
s AS (SELECT *, 'AR 001 (' || k || ')' AS source, '32024R' || lpad((id % 9989 + 10)::VARCHAR, 4, '0') AS act FROM p)"""


def _acts(spark, sf_dir):
    i, n, q = F.col("p_partkey"), F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 1).cast("string")
    said = {
        0: F.concat(F.lit("<TXT>in Article "), n, F.lit(", the following is added: more</TXT>")),
        1: F.concat(F.lit("<TXT>in Article "), n, F.lit("("), q, F.lit("), point (g) is replaced by the following:</TXT><QUOT.S><P>Article 99 is deleted</P></QUOT.S>")),
        2: F.lit("<TXT>in point (h) of Section 5.1 of Annex IX, the words are deleted</TXT>"),
        3: F.concat(F.lit('<TXT>the following Article is inserted:</TXT><QUOT.S><ARTICLE IDENTIFIER="0'), n, F.lit('A"><ALINEA>new</ALINEA></ARTICLE></QUOT.S>')),
        4: F.concat(F.lit("<TXT>Article "), n, F.lit(" is amended as follows:</TXT><P><LIST><ITEM><NP><NO.P>(a)</NO.P><TXT>paragraph "), q, F.lit(" is deleted</TXT></NP></ITEM></LIST></P>")),
        5: F.lit("<TXT>the date is replaced by another</TXT>"),
    }
    point = F.concat(F.lit("<ITEM><NP><NO.P>("), (i % 10).cast("string"), F.lit(")</NO.P>"), F.coalesce(*[F.when(i % 6 == f, x) for f, x in said.items()]), F.lit("</NP></ITEM>"))
    rows = table(spark, sf_dir, "part").select(F.floor(i / 10).cast("long").alias("id"), (i % 10).alias("k"), point.alias("point"))
    held = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "point"))), lambda x: x["point"]), "").alias("points"))
    number = (F.col("id") % 9989 + 10).cast("string")
    xml = F.concat(F.lit('<ACT><ENACTING.TERMS><ARTICLE IDENTIFIER="001"><TI.ART>Article 1</TI.ART><ALINEA>Regulation (EU) 2024/'), number, F.lit(" is amended as follows:<LIST>"), "points", F.lit("</LIST></ALINEA></ARTICLE></ENACTING.TERMS></ACT>"))
    return held.select("id", F.lit("act.xml").alias("name"), xml.cast("binary").alias("data"))


@query(
    f"""WITH {_ACTS_SQL} SELECT id, source || CASE f WHEN 4 THEN ' (a)' ELSE '' END AS source, act, CASE f WHEN 0 THEN 'AR ' || n WHEN 1 THEN 'AR ' || n || ' PA ' || q || ' PTA (g)' WHEN 2 THEN 'AN IX SCT 5.1 PTA (h)' WHEN 3 THEN 'AR ' || n || 'a' ELSE 'AR ' || n || ' PA ' || q END AS location,
  CASE WHEN f IN (0, 1) THEN 'modified' WHEN f = 3 THEN 'inserted' ELSE 'deleted' END AS change, f = 3 AS from_quotation FROM s WHERE f <> 5"""
)
def instruction_records(spark, sf_dir):
    """What amending acts say of the acts they name, point by point."""
    return instructions.read(_acts(spark, sf_dir), "id")["records"].select("id", *instructions.RECORD)


@query(f"WITH {_ACTS_SQL} SELECT id, source, 'the date is replaced by another' AS clause, 'no provision reference' AS reason FROM s WHERE f = 5")
def instruction_unread(spark, sf_dir):
    """Clauses that look like instructions and name no provision."""
    return instructions.read(_acts(spark, sf_dir), "id")["unread"].select("id", "source", "clause", "reason")


@query(
    f"""WITH {_ACTS_SQL}, c AS (SELECT act, CASE WHEN f = 2 THEN 'AN IX' WHEN f = 3 THEN 'AR ' || n || 'a' ELSE 'AR ' || n END AS unit, max(CASE WHEN f = 3 THEN 2 ELSE 1 END) AS s FROM s WHERE f <> 5 GROUP BY ALL),
d AS (SELECT DISTINCT act, 'AR ' || n AS unit, 'modified' AS diff_kind FROM s WHERE q < 5), m AS (SELECT coalesce(c.act, d.act) AS act, coalesce(c.unit, d.unit) AS unit, diff_kind, CASE s WHEN 2 THEN 'inserted' WHEN 1 THEN 'modified' END AS claimed_kind FROM c FULL JOIN d ON c.act = d.act AND c.unit = d.unit)
SELECT m.act, m.unit, diff_kind, claimed_kind, CASE WHEN diff_kind IS NOT NULL THEN 'observed' ELSE 'absent' END AS diff_status, CASE WHEN claimed_kind IS NOT NULL THEN 'observed' WHEN a.act IS NOT NULL THEN 'absent' ELSE 'unavailable' END AS claim_status,
  diff_kind IS NULL AS textless FROM m LEFT JOIN (SELECT DISTINCT act FROM c) a ON a.act = m.act"""
)
def instruction_signal_merge(spark, sf_dir):
    """The claims of amending acts beside a difference of the acts' units (of every part some)."""
    from ..operators import signals

    records = staged(instructions.read(_acts(spark, sf_dir), "id")["records"])
    i = F.col("p_partkey")
    act = F.concat(F.lit("32024R"), F.lpad((F.floor(i / 10) % 9989 + 10).cast("string"), 4, "0"))
    diff = table(spark, sf_dir, "part").where(i % 9 < 4).select(act.alias("act"), F.concat(F.lit("AR "), F.col("p_size").cast("string")).alias("unit"), F.lit("modified").alias("diff_kind")).distinct()
    claimed = instructions.claims(records, "id")
    merged = signals.merged(diff, claimed, claimed.select("act"))
    return merged.select("act", "unit", "diff_kind", "claimed_kind", "diff_status", "claim_status", "textless")
