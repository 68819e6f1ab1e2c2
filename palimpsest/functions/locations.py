"""Locations in a document: codes and values by depth, their order and their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import natural_text

#: Codes of a location's segments in their order.
CODES = (
    "AR", "TIT", "PRT", "SCT", "SECTION", "SBS", "PA", "ALN", "PTA", "PO", "PT", "PTI",
    "TIRE", "FR", "TXT", "TEXT", "TAB", "TABL", "COL", "NOTE", "FOOTNOTE", "AN", "APP",
)
#: Two spellings of one code.
ALIKE = {"TEXT": "TXT", "SECTION": "SCT", "TABL": "TAB"}
#: The codes whose values are written in brackets, and the words for others.
IN_BRACKETS = ("PA", "ALN", "PTA", "PO", "PT", "PTI", "TIRE", "FR")
WORDS = {
    "TIT": "title", "PRT": "part", "SCT": "section", "SECTION": "section", "SBS": "subsection", "TXT": "text", "TEXT": "text",
    "TAB": "table", "TABL": "table", "COL": "column", "NOTE": "note", "FOOTNOTE": "footnote", "AN": "annex", "APP": "appendix", "AR": "article",
}
#: Head codes of containers and recitals, which are no units of change; an annex without a number is one, too.
CONTAINERS = ("PRT", "CHA", "TIT", "TIS", "SCT", "SECTION", "P", "CONSID")
#: The largest annex number that is converted to a numeral.
MOST_ROMAN = 50
SEGMENT = "struct<code:string,value:string>"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalised(raw: Column) -> Column:
    """``{CODE|uri}`` templates become the code; white space runs become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\{(\w+)\|[^}]*\}", "$1"), r"\s+", " "))


def segments(location: Column) -> Column:
    """array<struct<code,value>>: a token where a segment begins is its code, the next one its value unless that is a known code."""
    none = F.array().cast(f"array<{SEGMENT}>")

    def step(held: Column, token: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        value = (F.size(held) > 0) & last["value"].isNull() & ~token.isin(*CODES)
        filled = F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.struct(last["code"].alias("code"), token.alias("value"))))
        fresh = F.concat(held, F.array(F.struct(token.alias("code"), F.lit(None).cast("string").alias("value"))))
        return F.when(value, filled).otherwise(fresh)

    tokens = F.filter(F.split(normalised(location), " "), lambda t: t != "")
    return F.aggregate(tokens, none, step)


def written(parsed: Column) -> Column:
    """The canonical string of parsed segments."""
    return F.array_join(F.transform(parsed, lambda s: F.concat_ws(" ", s["code"], s["value"])), " ")


def top_level(parsed: Column) -> Column:
    """The unit that a location lies in: its first segment."""
    return written(F.slice(parsed, 1, 1))


def preferred(code: Column) -> Column:
    """A code in its usual spelling, to compare meanings by; a canonical string keeps what the source wrote."""
    return F.coalesce(F.try_element_at(_map(ALIKE), code), code)


def sort_key(parsed: Column) -> Column:
    """A string that sorts as rank of the code, code and natural value, segment by segment; unknown codes come last."""
    ranks = _map({c: i for i, c in enumerate(CODES)})

    def one(s: Column) -> Column:
        rank = F.coalesce(F.try_element_at(ranks, s["code"]), F.lit(len(CODES)))
        return F.concat_ws("\x02", F.lpad(rank.cast("string"), 2, "0"), s["code"], natural_text(F.coalesce(s["value"], F.lit(""))))

    return F.array_join(F.transform(parsed, one), "\x01")  # below what separates runs, so a path sorts before its longer values


def human(parsed: Column) -> Column:
    """Display form: ``Art. 5(1)(bb)``, ``Annex III``; a code without a word is shown as it was written."""
    word = _map(WORDS)

    def head(s: Column) -> Column:
        known = F.try_element_at(word, s["code"])
        label = F.when((s["code"] == "AR") & s["value"].isNotNull(), F.lit("Art.")).otherwise(F.coalesce(F.initcap(known), s["code"]))
        return F.concat_ws(" ", label, s["value"])

    def tail(s: Column) -> Column:
        bracketed = F.when(F.startswith(s["value"], F.lit("(")), s["value"]).otherwise(F.concat(F.lit("("), s["value"], F.lit(")")))
        label = F.concat_ws(" ", F.coalesce(F.try_element_at(word, s["code"]), s["code"]), s["value"])
        return F.when(s["code"].isin(*IN_BRACKETS) & s["value"].isNotNull(), bracketed).otherwise(F.concat(F.lit(" "), label))

    return F.concat(head(parsed[0]), F.array_join(F.transform(F.slice(parsed, 2, 1_000_000), tail), ""))


def roman(number: Column, most: int = MOST_ROMAN) -> Column:
    """Roman numeral of 1 to ``most``, null otherwise."""
    tens = F.array(*map(F.lit, ("", "X", "XX", "XXX", "XL", "L")))
    ones = F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    n = number.try_cast("int")
    numeral = F.concat(F.try_element_at(tens, (F.floor(n / 10) + 1).cast("int")), F.try_element_at(ones, (n % 10 + 1).cast("int")))
    return F.when(n.between(1, most), numeral)


def unit_code(raw: Column) -> Column:
    """struct<code,gap,raw>: the whole location in the spelling of the markup, or why it names no unit.

    A dotted article goes by its head and an annex's number becomes a numeral; what follows the head's value stays. A
    container, a recital and an annex without a number have the gap ``container``, an annex numbered above ``MOST_ROMAN``
    has ``unconverted``; everything else is written as it came, normalised.
    """
    location = normalised(raw)
    parts = F.split(location, " ", -1)
    head, second = parts[0], F.try_element_at(parts, F.lit(2))
    value = F.when(~second.isin(*CODES), second)
    rest = F.array_join(F.slice(parts, 3, 1_000_000), " ")
    number = F.regexp_extract(value, r"^(\d+[a-z]*)\.\d", 1)
    arabic = (head == "AN") & value.rlike(r"^\d+$")

    def joined(new: Column) -> Column:
        return F.concat_ws(" ", head, new, F.when(rest != "", rest))

    container = head.isin(*CONTAINERS) | ((head == "AN") & value.isNull())
    gap = F.when(container, F.lit("container")).when(arabic & roman(value).isNull(), F.lit("unconverted"))
    code = F.when(value.isNotNull() & (head == "AR") & (number != ""), joined(number)).when(arabic, joined(roman(value))).otherwise(location)
    return F.struct(F.when(gap.isNull(), code).alias("code"), gap.alias("gap"), location.alias("raw"))


def digest_order(parsed: Column) -> Column:
    """Order of a notice: articles before annexes before the rest, numbers by value, letters last."""
    kind = F.when(parsed[0]["code"] == "AR", 0).when(parsed[0]["code"] == "AN", 1).otherwise(2)
    return F.concat_ws("\x02", kind.cast("string"), F.array_join(F.transform(parsed, lambda s: natural_text(F.coalesce(s["value"], F.lit("")))), "\x01"))
