"""Identifiers with check digits, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_sum(digits: Column, from_right: bool) -> Column:
    """Digits times their place, from 1, counted from either end."""
    n = F.char_length(digits)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places, F.lit(0), lambda total, i: total + F.substring(digits, i, F.lit(1)).cast("int") * (n - i + 1 if from_right else i)
    )


def cas_check(body: Column) -> Column:
    """Check digit of a registry number: places from the right, modulo 10."""
    return weighted_sum(body, True) % 10


def ec_check(body: Column) -> Column:
    """Check digit of a six-digit inventory number: places from the left, modulo 11, ten written 1."""
    left = weighted_sum(body, False) % 11
    return F.when(left == 10, F.lit(1)).otherwise(left)


def index_check(body: Column) -> Column:
    """Check sign of an eight-digit index number: places from the left, modulo 11, ten written X."""
    left = weighted_sum(body, False) % 11
    return F.when(left == 10, F.lit("X")).otherwise(left.cast("string"))


def cas_valid(first: Column, second: Column, check: Column) -> Column:
    plain = F.regexp_replace(first, "^0+", "")
    return (F.char_length(plain) >= 2) & (cas_check(F.concat(plain, second)) == check.cast("int"))


#: The parts of a number by scheme: digits in each, the last one its check sign.
SHAPES = {"cas": r"([0-9]{2,7})-([0-9]{2})-([0-9])", "ec": r"([2-9][0-9]{2})-([0-9]{3})-([0-9])", "index": r"([0-9]{3})-([0-9]{3})-([0-9]{2})-([0-9X])"}


def checked(scheme: str, value: Column) -> Column:
    """A number of this shape in its canonical form if its check sign holds, else null."""
    parts = F.split(value, "-")
    body = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "")
    check = F.element_at(parts, -1)
    if scheme == "cas":
        bare = F.regexp_replace(parts[0], "^0+", "")
        return F.when(cas_valid(parts[0], parts[1], check), F.concat_ws("-", bare, parts[1], check))
    holds = ec_check(body).cast("string") == check if scheme == "ec" else index_check(body) == check
    return F.when(holds, value)


def in_cell(cell: Column, schemes: tuple[str, ...] = ("cas", "ec", "index")) -> Column:
    """struct<found,failed>: the numbers of these schemes in a cell, each once, by scheme and in order; and how many of their shape
    fail their check. No number begins or ends inside a longer run of digits."""
    from .text import comparison_text, hyphens

    flat = hyphens(comparison_text(cell))

    def of(scheme: str) -> tuple[Column, Column]:
        read = F.regexp_extract_all(flat, F.lit(f"(?<![0-9-])({SHAPES[scheme]})(?![0-9-])"), F.lit(1))
        values = F.transform(read, lambda x: checked(scheme, x))
        valid = F.array_distinct(F.filter(values, lambda x: x.isNotNull()))
        return F.transform(valid, lambda x: F.struct(F.lit(scheme).alias("scheme"), x.alias("value"))), F.size(F.filter(values, lambda x: x.isNull()))

    found, lost = zip(*map(of, schemes))
    return F.struct(F.concat(*found).alias("found"), sum(lost, F.lit(0)).alias("failed"))


def act_identifier(raw: Column) -> Column:
    """struct<form,value,day>: an act as published (``celex``) or a dated version of one (``consolidated``), in whichever of its
    spellings; null for every other family, and for a version whose day doesn't exist.

    Fixed values: ``32024R1689``; ``02024R1689-20260727``; ``2024R1689/20260727`` with a number behind it or none; each with a family's
    name and a colon before it or without.
    """
    text = F.upper(F.trim(raw))
    rest = F.when(F.instr(text, ":") > 0, F.nullif(F.regexp_replace(text, "^[^:]*:", ""), F.lit("")))
    bare = F.coalesce(rest, text)
    code = "[0-9]{4}[A-Z]{1,2}[0-9]{4}"
    dated = bare.rlike(f"^0{code}-[0-9]{{8}}$") | bare.rlike(f"^{code}/[0-9]{{8}}(_[0-9]+)?$")
    digits = F.regexp_extract(bare, "[-/]([0-9]{8})", 1)
    day = F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")))
    version = F.struct(F.lit("consolidated").alias("form"), F.concat(F.lit("0"), F.when(bare.contains("/"), F.split_part(bare, F.lit("/"), F.lit(1))).otherwise(F.substring(F.split_part(bare, F.lit("-"), F.lit(1)), F.lit(2), F.lit(20))), F.lit("-"), digits).alias("value"), day.alias("day"))
    published = F.struct(F.lit("celex").alias("form"), bare.alias("value"), F.lit(None).cast("date").alias("day"))
    return F.when(dated & day.isNotNull(), version).when(bare.rlike(f"^[0-9]{code}$"), published)


def readable(scheme: Column) -> Column:
    """Whether identifiers of this family can be read at all."""
    return F.lower(scheme).isin("celex", "consolidation")
