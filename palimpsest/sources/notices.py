"""Notices as a source: what they say amended an act and where, and which versions of it exist.

A notice is nested XML. Its elements come as rows (:func:`.provisions.elements`); links, annotations and identifiers are joins over
them. What can't be read is a column with a reason or a count, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.identifiers import act_identifier
from ..functions.locations import normalised, segments, sort_key, top_level, unit_code, written
from ..operators.stages import staged
from .provisions import elements

#: The relation that carries annotations, those of consolidated versions, and roles with what they do.
AMENDED = "RESOURCE_LEGAL_AMENDED_BY_RESOURCE_LEGAL"
CONSOLIDATED = ("RESOURCE_LEGAL_CONSOLIDATED_BY_ACT_CONSOLIDATED", "RESOURCE_LEGAL_BASIS_FOR_ACT_CONSOLIDATED")
ROLES = {"R": "modified", "M": "modified", "C": "modified", "J": "inserted", "A": "inserted", "DEL": "deleted"}


def _rows(notices: DataFrame, by: list[str], data: str) -> DataFrame:
    rows = elements(notices, by, data)
    return staged(rows.select(*by, "pos", "parent", "up", "tag", F.array_join(F.concat(F.slice("tags", 2, 1_000_000), F.array("tag")), "/").alias("way"), F.trim(F.coalesce("text", F.lit(""))).alias("value")))


def _fields(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, field): of each element a map from a child's tag to the text of the first such child."""
    first = rows.where("parent IS NOT NULL").groupBy(*by, "parent", "tag").agg(F.min_by("value", "pos").alias("_v"))
    return first.groupBy(*by, F.col("parent").alias("pos")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "_v"))).alias("field"))


def _field(name: str) -> Column:
    return F.try_element_at("field", F.lit(name))


def role(raw: Column) -> Column:
    """The code of a role, in a template or bare; null for none."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(F.trim(raw), r"^\{(\w+)\|[^}]*\}$", "$1"))), F.lit(""))


def annotations(notices: DataFrame, by: list[str], data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of notices.

    ``records``: (by, pos, act, amending, location, unit, gap, role, change, day): an annotation of a link, in the spelling of the markup;
    ``gap`` says why a location is no unit, ``change`` is null for an unknown role. An annotation without a location is no record.
    ``gaps``: (by, n_records, missing_roles, unknown_roles, unreadable_locations, unreadable_dates, containers, unconverted): a row for
    each notice that is well formed.
    """
    rows = _rows(notices, by, data)
    fields = staged(_fields(rows, by))
    link = f"WORK/{AMENDED}"
    uris = rows.where(F.col("way") == f"{link}/SAMEAS/URI").join(fields, [*by, "pos"])
    uris = uris.where((_field("TYPE") == "celex") & (_field("IDENTIFIER") != "")).groupBy(*by, F.try_element_at("up", F.lit(-2)).alias("link")).agg(F.min_by(_field("IDENTIFIER"), "pos").alias("amending"))
    named = rows.where(F.col("way") == "WORK/ID_CELEX/VALUE").groupBy(*by).agg(F.min_by("value", "pos").alias("act"))
    found = rows.where(F.col("way") == f"{link}/ANNOTATION").select(*by, "pos", F.col("parent").alias("link")).join(fields, [*by, "pos"], "left")
    found = found.join(uris, [*by, "link"], "left").join(named, by, "left")
    raw, day = _field("REFERENCE_TO_MODIFIED_LOCATION"), _field("START_OF_VALIDITY")
    told = found.select(
        *by, "pos", "act", "amending", normalised(F.coalesce(raw, F.lit(""))).alias("raw"), unit_code(F.coalesce(raw, F.lit(""))).alias("u"), role(_field("ROLE2")).alias("role"), dates.iso(day).alias("day"), day.alias("stated")
    )
    told = staged(told)
    change = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("role"))
    location = F.coalesce("u.code", "u.raw")
    records = told.where("raw <> ''").select(*by, "pos", "act", "amending", written(segments(location)).alias("location"), top_level(segments(location)).alias("unit"), F.col("u.gap").alias("gap"), "role", change.alias("change"), "day")
    kept = F.col("raw") != ""
    counts = told.groupBy(*by).agg(
        F.count_if(kept).alias("n_records"), F.count_if(kept & F.col("role").isNull()).alias("missing_roles"), F.count_if(kept & F.col("role").isNotNull() & ~F.col("role").isin(*ROLES)).alias("unknown_roles"),
        F.count_if(~kept).alias("unreadable_locations"), F.count_if(kept & F.col("stated").isNotNull() & F.col("day").isNull()).alias("unreadable_dates"),
        F.count_if(kept & (F.col("u.gap") == "container")).alias("containers"), F.count_if(kept & (F.col("u.gap") == "unconverted")).alias("unconverted"),
    )
    every = rows.where("pos = 0").select(*by)
    return records, every.join(counts, by, "left").na.fill(0)


def touched_units(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, unit, key): the units that records name, once each; ``key`` sorts as locations do."""
    return records.where("gap IS NULL").select(*by, "unit").distinct().withColumn("key", sort_key(segments(F.col("unit"))))


def versions(notices: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """(by, version, kind, day, n_relations): the act as published, and its consolidated versions under either relation, once each.

    Versions of other acts that ride along are left out, as are those whose identifier can't be read.
    """
    rows = _rows(notices, by, data)
    own = rows.where(F.col("way") == "WORK/ID_CELEX/VALUE").groupBy(*by).agg(F.min_by("value", "pos").alias("celex"))
    day = rows.where(F.col("way") == "WORK/WORK_DATE_DOCUMENT/VALUE").groupBy(*by).agg(F.min_by("value", "pos").alias("_day"))
    original = own.join(day, by, "left").select(*by, F.col("celex").alias("version"), F.lit("original").alias("kind"), dates.iso(F.col("_day")).alias("day"), F.lit(0).cast("long").alias("n_relations"))
    ways = {f"WORK/{r}/EMBEDDED_NOTICE/WORK/ID_CELEX/VALUE": r for r in CONSOLIDATED}
    each = rows.where(F.col("way").isin(*ways)).groupBy(*by, "way", "parent").agg(F.min_by("value", "pos").alias("value")).withColumn("x", act_identifier(F.col("value")))
    mine = each.join(own, by).where((F.col("x.form") == "consolidated") & (F.substring("x.value", 2, 9) == F.substring("celex", 2, 9)))
    dated = mine.groupBy(*by, F.col("x.value").alias("version")).agg(F.first("x.day").alias("day"), F.count_distinct("way").alias("n_relations"))
    return original.unionByName(dated.select(*by, "version", F.lit("consolidated").alias("kind"), "day", "n_relations"))
