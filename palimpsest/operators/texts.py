"""Text operators over pairs of versions: containment, excerpts, masks, date moves, lines, fuzzy re-keying."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, comparison_text, digest
from .similarity import opcodes, words

#: Least length and number of a fuzzy renumbering, the prefix it compares and the ratio it needs.
FUZZY_CHARS, FUZZY_SIDE, FUZZY_PREFIX, FUZZY_RATIO = 100, 50, 2000, 0.95
#: Context, length and number of the excerpts of a difference, and the share from which it is withheld.
CONTEXT_WORDS, EXCERPT_CHARS, EXCERPTS, WITHHELD, CUT = 6, 400, 12, 0.30, "[…]"


def quoted(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str, width: int = 5) -> DataFrame:
    """(quote_key, text_key): texts that hold a quote, in whole words of their comparison texts.

    A text with the quote has the quote's first words as a run of its own, so an equal join on the
    run (of ``width`` words, or the whole of a shorter quote) finds every pair, and only those are
    searched. An empty quote is in no text.
    """
    q = quotes.select(F.col(quote_key), comparison_text(F.col("text")).alias("quote")).where("quote <> ''")
    q = q.withColumn("n", F.least(F.size(words(F.col("quote"))), F.lit(width))).withColumn("run", F.xxhash64(F.slice(words(F.col("quote")), F.lit(1), F.col("n"))))
    widths = sorted(r.n for r in q.select("n").distinct().collect())  # width values at most

    def of_width(c, n: int):
        each = F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.xxhash64(F.slice(c, i, n)))
        return F.when(F.size(c) >= n, each).otherwise(F.array().cast("array<bigint>"))

    def runs(c):
        return F.array_distinct(F.flatten(F.array(*[of_width(c, n) for n in widths or [width]])))

    held = texts.select(F.col(text_key), F.explode(bound(words(F.col("text")), runs)).alias("run"))
    found = held.join(q.select(quote_key, "run", "quote"), "run").select(text_key, quote_key, "quote").distinct()
    whole = texts.select(text_key, F.concat(F.lit(" "), comparison_text(F.col("text")), F.lit(" ")).alias("padded"))
    return found.join(whole, text_key).where(F.contains("padded", F.concat(F.lit(" "), "quote", F.lit(" ")))).select(quote_key, text_key)


def lines(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, digest): the non-blank lines of each text with their numbers."""
    each = nodes.select(*keys, F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return each.select(*keys, F.col("line").cast("long").alias("line"), comparison_text(F.col("t")).alias("t")).where("t <> ''").select(*keys, "line", digest(F.col("t")).alias("digest"))


def changed_lines(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, change_type): lines below a unit that differ between its versions, by number."""
    old, new = (lines(v, *keys).withColumnRenamed("digest", n) for v, n in ((before, "old"), (after, "new")))
    both = old.join(new, [*keys, "line"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), F.lit("inserted")).when(F.col("new").isNull(), F.lit("deleted")).otherwise(F.lit("modified"))
    return both.select(*keys, "line", kind.alias("change_type"))


def fuzzy_units(left_over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units that fuzzy matching may take, acts passed over) of ``act, location, change_type, text``.

    Units count from ``FUZZY_CHARS`` of comparison text; an act with none or more than ``FUZZY_SIDE`` of them
    on a side is passed over, which is told as ``act, n_deleted, n_inserted``.
    """
    compared = left_over.withColumn("text", comparison_text(F.col("text")))
    fit = compared.where((F.char_length("text") >= FUZZY_CHARS) & F.col("change_type").isin("deleted", "inserted"))
    sides = fit.groupBy("act").agg(*[F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in ("deleted", "inserted")])
    within = F.col("n_deleted").between(1, FUZZY_SIDE) & F.col("n_inserted").between(1, FUZZY_SIDE)
    return fit.join(sides.where(within), "act", "left_semi"), sides.where(~within)


def fuzzy_renumberings(left_over: DataFrame) -> DataFrame:
    """(act, old_location, new_location, ratio) among ``act, location, change_type, text`` that exact matching left.

    Pairs of an act whose lengths allow ``FUZZY_RATIO`` are scored on their first ``FUZZY_PREFIX`` characters,
    each on its own; an act's scored pairs (``FUZZY_SIDE`` squared at most) are settled best first, each unit once.
    """
    units, _ = fuzzy_units(left_over)
    head = F.substring("text", 1, FUZZY_PREFIX)
    old, new = (
        units.where(F.col("change_type") == kind).select("act", F.col("location").cast("string").alias(f"{name}_location"), head.alias(name), F.char_length(head).alias(f"n_{name}"))
        for kind, name in (("deleted", "old"), ("inserted", "new"))
    )
    possible = 2 * F.least("n_old", "n_new") >= FUZZY_RATIO * (F.col("n_old") + F.col("n_new"))

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        matchers = [difflib.SequenceMatcher(None, x, y, autojunk=False) for x, y in zip(a, b)]
        return pd.Series([m.ratio() if m.quick_ratio() >= FUZZY_RATIO else 0.0 for m in matchers], dtype="float64")

    pairs = old.join(new, "act").where(possible).withColumn("ratio", F.pandas_udf(ratios, "double")("old", "new")).where(F.col("ratio") >= FUZZY_RATIO)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs that are the best of both their units, round after round."""
        open_ = rows.sort_values(["ratio", "old_location", "new_location"], ascending=[False, True, True])
        taken = []
        while len(open_):
            best = open_[~(open_.duplicated("old_location") | open_.duplicated("new_location"))]
            taken.append(best)
            open_ = open_[~(open_.old_location.isin(best.old_location) | open_.new_location.isin(best.new_location))]
        return pd.concat(taken)

    scored = pairs.select("act", "old_location", "new_location", "ratio")
    return scored.groupBy("act").applyInPandas(settle, "act string, old_location string, new_location string, ratio double")


DATE = r"(\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b)"


def date_verdict(before: str, after: str):
    """struct<verdict,removed,added> of two text columns: ``deferred`` if nothing but dates moved and one came,
    ``unchanged`` if no date moved, else ``unknown``."""
    held = {side: F.regexp_extract_all(F.coalesce(F.col(side), F.lit("")), F.lit(DATE), F.lit(1)) for side in (before, after)}
    rest = {side: comparison_text(F.regexp_replace(F.coalesce(F.col(side), F.lit("")), DATE, "#")) for side in (before, after)}
    removed, added = (F.array_sort(F.array_except(held[x], held[y])) for x, y in ((before, after), (after, before)))
    moved = F.size(removed) + F.size(added)
    verdict = F.when(moved == 0, F.lit("unchanged")).when((rest[before] == rest[after]) & (F.size(added) == 1), F.lit("deferred")).otherwise(F.lit("unknown"))
    return F.struct(verdict.alias("verdict"), removed.alias("removed"), added.alias("added"))


def excerpts(before: str, after: str) -> tuple[bool, int, list[dict]]:
    """(withheld, omitted, passages): both sides of each difference with the words around it, cut where too long.

    The first ``EXCERPTS`` are kept and the rest counted. If what is kept shows more than ``WITHHELD`` of either text, none is.
    """
    x, y = before.split(), after.split()
    before, after = " ".join(x), " ".join(y)
    if before == after:
        return False, 0, []

    def side(words_: list[str], start: int, end: int) -> str:
        shown = " ".join(words_[max(0, start - CONTEXT_WORDS) : end + CONTEXT_WORDS])
        return shown if len(shown) <= EXCERPT_CHARS else shown[:EXCERPT_CHARS] + CUT

    regions = [op for op in opcodes(x, y) if op[0] != "equal"]
    kept = [{"before": side(x, i, j), "after": side(y, k, n)} for _, i, j, k, n in regions[:EXCERPTS]]
    if any(sum(len(p[name]) for p in kept) > WITHHELD * len(text) for name, text in (("before", before), ("after", after))):
        return True, 0, []
    return False, max(0, len(regions) - EXCERPTS), kept


def excerpt(before: str, after: str):
    """:func:`excerpts` of two text columns."""

    def shown(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([excerpts(x or "", y or "") for x, y in zip(a, b)], columns=["withheld", "omitted", "passages"])

    return F.pandas_udf(shown, "struct<withheld:boolean,omitted:int,passages:array<struct<before:string,after:string>>>")(before, after)


#: The nouns that a number belongs to, and the words that join several numbers.
NUMBERED = ("article", "annex", "chapter", "section", "title", "part", "point", "paragraph")
JOINING = ("and", "or", "to")


def _plural(noun: str) -> str:
    return noun + ("(es)?" if noun.endswith("x") else "s?")


#: A bracketed label, and what a number may look like before its labels.
_LABEL = r"\(([a-z]{1,4}|[0-9]+[a-z]?)\)"
_SHAPES = {"arabic": r"[0-9]+(\.[0-9]+)*[a-z]?", "roman": r"[CILVX]+[a-z]?", "letter": r"[A-Z]"}
_ONE = f"({'|'.join(_SHAPES.values())})({_LABEL})*"
#: A noun with its number and those joined to it, in a text with single blanks.
_PHRASE = rf"\b(?i:{'|'.join(map(_plural, NUMBERED))}) {_ONE}((, ?| ({'|'.join(JOINING)}) ){_ONE})*(?![\w/])"


def numbering_masked(text):
    """A comparison text in which numbers are '#' where they number: after a noun, joined to such a number, or as a label alone.

    The text is cut at its phrases; within a phrase every number that follows a blank or a comma is masked. Dates, years and
    amounts stand in no phrase and stay. A label alone has three digits at most, so a year in brackets stays, too.
    """
    phrases = F.regexp_extract_all(text, F.lit(_PHRASE), F.lit(0))
    numbers = F.transform(phrases, lambda p: F.regexp_replace(p, f"(?<=[ ,]){_ONE}", "#"))
    between = F.split(text, _PHRASE, -1)
    masked = F.array_join(F.flatten(F.zip_with(between, numbers, lambda b, n: F.array(b, F.coalesce(n, F.lit(""))))), "")
    alone = r"(?<![^ ])\(([a-z]{1,4}|[0-9]{1,3}[a-z]?)\)(?![\w(])"
    return F.regexp_replace(masked, alone, "(#)")


def numbering_only(before, after):
    """Whether two comparison texts differ, and in nothing but their numbering."""
    return (before != after) & (numbering_masked(before) == numbering_masked(after))
