"""Where a sentence points: the provisions that amending prose and explanations name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .locations import SEGMENT, segments, top_level

#: Written ordinals.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_ORDINAL = f"the ({'|'.join(ORDINALS)})"
_ROMAN_OR_DIGITS = r"([CDILMVX]+|[0-9]+[a-z]?)\b"

#: What a clause may name: how deep it nests, its code, the words (one group: the value), and how the value is written.
FORMS = (
    (0, "AR", r"(?i)\barticles? ([0-9]+[a-z]?)", "small"),
    (0, "AN", rf"(?i)\bannex(?:es)? {_ROMAN_OR_DIGITS}", "capital"),
    (0, "APP", rf"(?i)\bappendix {_ROMAN_OR_DIGITS}", "capital"),
    (1, "TIT", r"(?i)\bthe (heading)\b", "none"),
    (2, "PRT", r"\b[Pp](?:art|ARTS?|arts) ([CDILMVX]{1,6}|[A-Z]|[0-9]+)\b", "capital"),
    (3, "SCT", r"(?i)\bsections? ([0-9a-z](?:[0-9a-z.]*[0-9a-z])?)(?=\.?(?:[ ,]|$))", "as it is"),
    (5, "PA", r"(?i)\barticles? [0-9]+[a-z]? ?\(([0-9]+[a-z]?)\)", "small"),
    (5, "PA", r"(?i)\bparagraphs? ([0-9]+[a-z]?)", "small"),
    (5, "PA", rf"(?i)\b{_ORDINAL} paragraph\b", "ordinal"),
    (6, "ALN", rf"(?i)\b{_ORDINAL} subparagraph\b", "ordinal"),
    (7, "TIRE", rf"(?i)\b{_ORDINAL} indent\b", "ordinal"),
    (7, "PO", r"(?i)\bpoints? \(?([0-9]{1,3}(?=\))|[0-9]+(?!\)))", "as it is"),
    (7, "PTA", r"(?i)\bpoints? \(([0-9]{0,2}[a-z][0-9a-z]{0,2})\)", "bracketed"),
)
TOP = ("AR", "AN", "APP")


def reference_segments(clause: Column) -> Column:
    """array<struct<code,value>>: the provisions a clause names, outermost first, whichever way it was written.

    Of each depth the first that is named stands, so ``points 7 and 9`` is point 7. ``clause`` has single blanks.
    """
    ordinal = F.create_map(*[F.lit(x) for i, w in enumerate(ORDINALS, 1) for x in (w, str(i))])
    written = {
        "small": F.lower, "capital": F.upper, "as it is": lambda v: v, "none": lambda v: F.lit(None).cast("string"),
        "ordinal": lambda v: F.try_element_at(ordinal, F.lower(v)), "bracketed": lambda v: F.concat(F.lit("("), F.lower(v), F.lit(")")),
    }
    named = [
        F.struct(F.lit(depth).alias("depth"), F.regexp_instr(clause, F.lit(words)).alias("at"), F.lit(code).alias("code"), written[how](F.regexp_extract(clause, words, 1)).alias("value"))
        for depth, code, words, how in FORMS
    ]
    found = F.array_sort(F.filter(F.array(*named), lambda n: n["at"] > 0))
    none = F.array().cast("array<struct<depth:int,code:string,value:string>>")
    last = lambda held: F.try_element_at(held, F.lit(-1))["depth"]
    first = F.aggregate(
        found,
        none,
        lambda held, n: F.when(last(held).eqNullSafe(n["depth"]), held).otherwise(F.concat(held, F.array(F.struct(n["depth"].alias("depth"), n["code"].alias("code"), n["value"].alias("value"))))),
    )
    return F.transform(first, lambda n: F.struct(n["code"].alias("code"), n["value"].alias("value"))).cast(f"array<{SEGMENT}>")


def resolved(clause: Column, context: Column) -> Column:
    """The segments that a clause means inside ``context`` (segments or null): its own from the top, or else behind the context's."""
    own, context = reference_segments(clause), context.cast(f"array<{SEGMENT}>")
    absolute = (F.size(own) > 0) & own[0]["code"].isin(*TOP)
    joined = F.when(absolute | context.isNull(), own).otherwise(F.concat(context, own))
    return F.when(F.size(joined) > 0, joined)


_BRACKET = r"\([0-9a-z]{1,4}\)"
_NUMBER = rf"[0-9]{{1,3}}[a-z]?(?:{_BRACKET})*"


def coordinates(sentence: Column, unit: Column) -> Column:
    """The locations of its own article that a sentence names, each once, in order; none for a unit that is no article.

    Read are ``paragraph 3``, lists and the ends of ranges of paragraphs, a lettered point right behind one, and the unit's own
    ``Article N(2)(a)``. Whatever ``of`` follows belongs to another act or article and is not read.
    """
    head = segments(unit)[0]
    own = F.when(head["code"] == "AR", F.lower(head["value"]))
    between = r"(?: ?, ?(?:(?:and|or) )?| (?:and|or|to) )"
    lists = F.regexp_extract_all(sentence, F.lit(rf"(?i)\bparagraphs? ({_NUMBER}(?:{between}{_NUMBER})*(?: of\b)?)"), F.lit(1))
    items = F.flatten(F.transform(F.filter(lists, lambda p: ~F.lower(p).endswith(" of")), lambda p: F.regexp_extract_all(p, F.lit(rf"(?i)({_NUMBER})"), F.lit(1))))
    cited = F.regexp_extract_all(sentence, F.lit(rf"(?i)\barticle ([0-9]{{1,3}}[a-z]? ?(?:{_BRACKET})+(?: of\b)?)"), F.lit(1))
    mine = F.filter(cited, lambda c: ~F.lower(c).endswith(" of") & (F.lower(F.regexp_extract(c, "^[0-9]+[a-zA-Z]?", 0)) == own))
    # an article's first bracket is the paragraph, so the rest reads as an item of a list does
    behind = F.filter(F.transform(mine, lambda c: F.regexp_replace(F.regexp_replace(c, r"^[^(]*\(", ""), r"^([^)]*)\)", "$1")), lambda i: i.rlike(r"^[0-9]+(\(|$)"))

    def place(item: Column) -> Column:
        point = F.lower(F.regexp_extract(item, r"\(([0-9a-zA-Z]+)\)", 1))
        tail = F.when((point != "") & ~point.rlike("^[0-9]+$"), F.concat(F.lit(" PTA ("), point, F.lit(")"))).otherwise(F.lit(""))
        return F.concat(top_level(segments(unit)), F.lit(" PA "), F.lower(F.regexp_extract(item, "^[0-9]+[a-zA-Z]?", 0)), tail)

    return F.when(own.isNotNull(), F.array_sort(F.array_distinct(F.transform(F.concat(items, behind), place)))).otherwise(F.array().cast("array<string>"))


def anchor(location: Column) -> Column:
    """The anchor of a location's unit in a published page: an article's by its number, an annex's by its numeral; else null."""
    head = segments(location)[0]
    article = F.nullif(F.regexp_extract(head["value"], "^[0-9]+[A-Za-z]?", 0), F.lit(""))
    annex = F.when(F.upper(head["value"]).rlike("^([CDILMVX]+|[0-9]+[A-Z]?)$"), F.upper(head["value"]))
    return F.when(head["code"] == "AR", F.concat(F.lit("art_"), F.lower(article))).when(head["code"] == "AN", F.concat(F.lit("anx_"), annex))


#: Fixed value: where acts are published.
PAGE = "https://eur-lex.europa.eu/legal-content/EN/TXT/HTML/?uri=CELEX:"


def citation_url(version: Column, location: Column) -> Column:
    """The page of a version, at the deepest anchor that it has for a location."""
    return F.concat_ws("#", F.concat(F.lit(PAGE), version), anchor(location))
