"""Text functions: comparison form, digests, order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as document comparison sees it: ASCII controls, NEL and every Unicode separator.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"

#: Dash forms read as a hyphen.
DASHES = "‐‑‒–−"


def comparison_text(text: Column) -> Column:
    """White space runs as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def digest(text: Column) -> Column:
    """SHA-256 of a comparison text; null stays null, so absent and empty differ."""
    return F.sha2(text.cast("binary"), 256)


def hyphens(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def roman_value(token: Column) -> Column:
    """The value of a Roman numeral in capitals, null for any other text; a lone L, C, D or M is text."""
    t = token
    #: fixed value: the form of a Roman numeral
    numeral = t.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (t != "") & ~t.isin("L", "C", "D", "M")
    worth = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    values = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.try_element_at(worth, c))
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(numeral, total)


def natural_text(value: Column) -> Column:
    """A string that sorts naturally: a Roman numeral by value, else digit and other runs, numbers before text; a number goes by
    how many digits it has, then by them."""

    def number(digits: Column) -> Column:
        bare = F.regexp_replace(digits, "^0+", "")
        return F.concat(F.lit("0"), F.lpad(F.char_length(bare).cast("string"), 6, "0"), bare)

    runs = F.regexp_extract_all(value, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    plain = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(F.concat(F.lit("1"), r))), "\x02")
    roman = roman_value(value)
    return F.when(roman.isNotNull(), number(roman.cast("string"))).otherwise(plain)


def contains_path(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` is ``outer`` or below it: whole path tokens, so ``AR 60`` isn't in ``AR 6``."""
    return (inner == outer) | F.startswith(inner, F.concat(outer, F.lit(" ")))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` puts it into a loop over an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def capped(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def heading_key(heading: Column) -> Column:
    """Headings that are equal but for case, blanks and closing marks share it."""
    return F.regexp_replace(F.lower(comparison_text(heading)), r"[.:;]+$", "")


def ratio(numerator: Column, denominator: Column) -> Column:
    """A share that is 1 where there is nothing to share."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(numerator / F.nullif(denominator, F.lit(0)))


def rounded(share: Column) -> Column:
    """A share as published: three places, halves to even."""
    return F.bround(share, 3)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
