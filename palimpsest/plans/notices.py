"""Queries on notices: a notice holds ten parts, an annotation for each, under two links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.stages import staged
from ..sources import notices
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


_SQL = """p AS (SELECT p_partkey // 10 AS id, p_partkey % 7 AS f, p_size AS n, p_partkey % 2 AS late, p_partkey AS k FROM part),
a AS (SELECT *, '32024R' || lpad((id % 10000)::VARCHAR, 4, '0') AS act, CASE late WHEN 1 THEN '32026R1744' END AS amending FROM p)"""


def _notices(spark, sf_dir):
    """(id, data): notices with annotations of seven forms, and versions under both relations."""
    i, n = F.col("p_partkey"), F.col("p_size").cast("string")

    def annotation(location, role: str, day: str):
        return F.concat(F.lit("<ANNOTATION><REFERENCE_TO_MODIFIED_LOCATION>"), location, F.lit(f"</REFERENCE_TO_MODIFIED_LOCATION>{role}{day}</ANNOTATION>"))

    day = "<START_OF_VALIDITY>{}</START_OF_VALIDITY>".format
    forms = {
        0: annotation(F.concat(F.lit("{AR|http://x/AR} "), n, F.lit(" {PA|http://x/PA} 1")), "<ROLE2>{J|http://x/J}</ROLE2>", day("2026-07-27")),
        1: annotation(F.concat(F.lit("AN "), n), "<ROLE2>DEL</ROLE2>", day("2007/11/23")),
        2: annotation(F.concat(F.lit("CHA "), n), "", ""),
        3: annotation(F.lit(" "), "<ROLE2>R</ROLE2>", ""),
        4: annotation(F.concat(F.lit("AR "), n, F.lit(".1")), "<ROLE2>QQ</ROLE2>", day("soon")),
        5: annotation(F.lit("AN 99"), "<ROLE2>r</ROLE2>", ""),
        6: annotation(F.concat(F.lit("AR "), n), "<ROLE2/>", day("2025-01-01")),
    }
    each = table(spark, sf_dir, "part").select(F.floor(i / 10).cast("long").alias("id"), (i % 2).alias("late"), i.alias("k"), F.coalesce(*[F.when(i % 7 == f, x) for f, x in forms.items()]).alias("x"))
    sides = {late: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("late") == late, F.struct("k", "x")))), lambda a: a["x"]), "").alias(f"x{late}") for late in (0, 1)}
    held = each.groupBy("id").agg(*sides.values())
    number = F.lpad((F.col("id") % 10_000).cast("string"), 4, "0")

    def version(relation: str, code, at: str):
        return F.concat(F.lit(f"<{relation}><EMBEDDED_NOTICE><WORK><ID_CELEX><VALUE>0"), code, F.lit(f"-{at}</VALUE></ID_CELEX></WORK></EMBEDDED_NOTICE></{relation}>"))

    code, (one, two), link = F.concat(F.lit("2024R"), number), notices.CONSOLIDATED, notices.AMENDED
    xml = F.concat(
        F.lit("<NOTICE><WORK><ID_CELEX><VALUE>3"), code, F.lit(f"</VALUE></ID_CELEX><WORK_DATE_DOCUMENT><VALUE>2024-06-13</VALUE></WORK_DATE_DOCUMENT><{link}>"), "x0",
        F.lit(f"</{link}><{link}><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>32026R1744</IDENTIFIER></URI></SAMEAS>"), "x1", F.lit(f"</{link}>"),
        version(one, code, "20250101"), version(two, code, "20250101"), F.when(F.col("id") % 3 == 0, version(two, code, "20260727")).otherwise(version(one, F.lit("2023R0001"), "20260727")), F.lit("</WORK></NOTICE>"),
    )
    return staged(held.select("id", xml.cast("binary").alias("data")))


@query(
    f"""WITH {_SQL}, l AS (SELECT *, CASE f WHEN 0 THEN 'AR ' || n || ' PA 1' WHEN 1 THEN CASE WHEN n <= 50 AND n > 0 THEN 'AN ' || ['', 'X', 'XX', 'XXX', 'XL', 'L'][n // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] ELSE 'AN ' || n END WHEN 2 THEN 'CHA ' || n WHEN 5 THEN 'AN 99' ELSE 'AR ' || n END AS location FROM a WHERE f <> 3)
SELECT id, act, amending, location, CASE f WHEN 0 THEN 'AR ' || n ELSE location END AS unit, CASE WHEN f = 2 THEN 'container' WHEN f = 5 OR (f = 1 AND n NOT BETWEEN 1 AND 50) THEN 'unconverted' END AS gap, CASE f WHEN 0 THEN 'J' WHEN 1 THEN 'DEL' WHEN 4 THEN 'QQ' WHEN 5 THEN 'R' END AS role,
  CASE f WHEN 0 THEN 'inserted' WHEN 1 THEN 'deleted' WHEN 5 THEN 'modified' END AS change, CASE f WHEN 0 THEN DATE '2026-07-27' WHEN 1 THEN DATE '2007-11-23' WHEN 6 THEN DATE '2025-01-01' END AS day FROM l"""
)
def notice_annotations(spark, sf_dir):
    """What notices say was changed, where, by which act and from when."""
    return notices.annotations(_notices(spark, sf_dir), ["id"])[0].drop("pos")


@query(
    f"""WITH {_SQL} SELECT id, count(*) FILTER (f <> 3) AS n_records, count(*) FILTER (f IN (2, 6)) AS missing_roles, count(*) FILTER (f = 4) AS unknown_roles, count(*) FILTER (f = 3) AS unreadable_locations, count(*) FILTER (f = 4) AS unreadable_dates,
  count(*) FILTER (f = 2) AS containers, count(*) FILTER (f = 5 OR (f = 1 AND n NOT BETWEEN 1 AND 50)) AS unconverted FROM a GROUP BY 1"""
)
def notice_gaps(spark, sf_dir):
    """How much of each notice couldn't be read, by kind."""
    return notices.annotations(_notices(spark, sf_dir), ["id"])[1]


@query(
    f"""WITH {_SQL}, i AS (SELECT DISTINCT id, '2024R' || lpad((id % 10000)::VARCHAR, 4, '0') AS code FROM p)
SELECT id, '3' || code AS version, 'original' AS kind, DATE '2024-06-13' AS day, 0 AS n_relations FROM i UNION ALL SELECT id, '0' || code || '-20250101', 'consolidated', DATE '2025-01-01', 2 FROM i
UNION ALL SELECT id, '0' || code || '-20260727', 'consolidated', DATE '2026-07-27', 1 FROM i WHERE id % 3 = 0"""
)
def notice_versions(spark, sf_dir):
    """The versions of each act that its notice lists, under either relation, without those of other acts."""
    return notices.versions(_notices(spark, sf_dir), ["id"])
