"""Instructions of an amending act: what its clauses change in other acts, read from its own markup.

Clauses are points in lists below an article. Each is its own words: without its mark, the list below it, headings and what it
quotes. What it points at is read inside what stands above it, up to the sentence that opens the list. A clause that looks like an
instruction and yields no record is told as unread.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import references
from ..functions.locations import SEGMENT, written
from . import outline
from .packages import well_formed

#: What isn't a clause's own, what may be quoted, and the mark of quoted structure.
NOT_OWN = ("NO.P", "LIST", "QUOT.S", "TI.ART", "STI.ART")
QUOTED = ("ARTICLE", "PARAG")
QUOTE = "QUOT.S"
#: How a clause says what it does; the first that fits counts. ``amends`` opens a list and is no change of its own.
VERBS = (("amends", "amended as follows"), ("modified", "(?:is|are) replaced"), ("deleted", "(?:is|are) deleted"), ("inserted", "(?:is|are) (?:inserted|added)"))
HINTS = "amended amendment replaced deleted inserted added renumbered substituted".split()
#: Characters of an article that are read for the act it names, and the years an act may have.
LEAD, YEARS = 400, (1952, 2099)

RECORD = ["source", "location", "change", "act", "from_quotation"]


def verb(clause: Column) -> Column:
    """What a clause does: ``amends``, ``modified``, ``deleted``, ``inserted`` or null."""
    return F.coalesce(*[F.when(clause.rlike(rf"(?i)\b{words}\b"), F.lit(kind)) for kind, words in VERBS])


_REGULATION = re.compile(r"\b(?ai:regulations? ?\((?:eu|ec|eec|euratom)(?:, ?euratom)?\) ?((?:no\.? ?)?[0-9]{1,4}/[0-9]{2,4}))")


def _named_act(text: str | None) -> str | None:
    found = _REGULATION.search(text[:LEAD]) if text is not None else None
    if found is None:
        return None
    pair = re.sub("^[^0-9]*", "", found[1]).split("/")
    year, number = pair if found[1][0].isdigit() else pair[::-1]
    likely = len(year) == 4 and YEARS[0] <= int(year) <= YEARS[1] and 1 <= int(number) <= 9999
    return f"3{year}R{int(number):04d}" if likely else None


def named_act(text: Column) -> Column:
    """The regulation that a text names first, as an act's identifier; null for other acts, two-digit years and unlikely ones.

    The older style has the number first, behind ``No``; the newer one the year.
    """

    @F.pandas_udf("string")
    def named(column: pd.Series) -> pd.Series:
        return column.map(_named_act, na_action="ignore")

    return named(text)


def _quoted(node: outline.Node) -> tuple[str | None, str | None] | None:
    """(location, file) of an outermost article or paragraph in quoted structure, with the location that it has in its act, or of
    an included file; null for any other element."""
    if node.tag not in (*QUOTED, "INCL.ELEMENT") or QUOTE not in node.steps:
        return None
    within = node.steps[node.steps.index(QUOTE) + 1 :]
    if not within or any(t in QUOTED for t in within[:-1]):
        return None
    raw, location = node.element.get("IDENTIFIER"), None
    if node.tag == "ARTICLE":
        number = outline.article_number(node.element)
        location = None if number is None else f"AR {number}"
    elif node.tag == "PARAG" and raw is not None and "." in raw:
        above, below = (outline.identifier(x) for x in (raw.split(".")[0], raw.split(".", 1)[1]))
        location = None if above is None or below is None else f"AR {above} PA {below}"
    return location, node.element.get("FILEREF")


def _is_point(steps: tuple[str, ...]) -> bool:
    """Whether a way leads by lists alone: ``ALINEA``, or nothing, then a list's point and points of lists inside points."""
    below = steps[1:] if steps and steps[0] == "ALINEA" else steps
    return len(below) >= 3 and below[:3] == ("LIST", "ITEM", "NP") and len(below) % 4 == 3 and all(below[i : i + 4] == ("P", "LIST", "ITEM", "NP") for i in range(3, len(below), 4))


def _of_article(unit: list[outline.Node]) -> list[tuple]:
    """(pos, number, chain, quotes) of the clauses without clauses below them in one article, its nodes given in document order.

    ``chain`` is what stands above a clause, from the sentence that opens its list down to itself: (mark, clause, opens).
    """
    top = unit[0]
    hosts = {n.parent.pos for n in unit if n.steps == ("ALINEA", "LIST")}
    style = "ALINEA" if hosts else "LIST" if any(n.steps == ("LIST",) for n in unit) else None
    first: dict[int, int] = {}  # of an item its first point counts
    for n in unit:
        if n.tag == "NP" and n.parent is not None:
            first.setdefault(n.parent.pos, n.pos)
    clauses = [n for n in unit if _is_point(n.steps) and n.steps[0] == style and first[n.parent.pos] == n.pos] if style else [top]
    nested = {n.parent.parent.pos for n in unit if n.tag == "LIST" and n.parent is not None and n.parent.tag == "P" and n.parent.parent is not None}
    wanted, said = hosts | {n.pos for n in clauses}, {}
    leaves = {n.pos: [] for n in clauses if n.pos not in nested}
    for n in unit:
        found = _quoted(n)
        above = n.parent
        while found is not None and above is not None:
            if above.pos in leaves:
                leaves[above.pos].append(found)
            above = above.parent
    out = []
    for n in clauses:
        if n.pos not in leaves:
            continue
        chain, at = [], n
        while at is not None:
            if at.pos in wanted:
                if at.pos not in said:
                    said[at.pos] = (outline.titled(at.element, "NO.P").strip(" "), outline.flat(at.element, NOT_OWN), at.pos in hosts)
                chain.append(said[at.pos])
            at = at.parent
        number = top.element.get("IDENTIFIER")
        out.append((n.pos, "?" if number is None else number, chain[::-1], leaves[n.pos]))
    return out


def _of_document(root) -> tuple[str | None, list[tuple]]:
    """The location of a document's first numbered unit, and (the act that it names, its clauses) of each article."""
    units: list[list[outline.Node]] = []
    for node in outline.nodes(root):
        if node.unit is node:
            units.append([])
        units[-1].append(node)
    places = (outline.segment(unit[0]) for unit in units)
    location = next((" ".join(p) for p in places if p is not None), None)
    return location, [(_named_act(outline.flat(unit[0].element)), _of_article(unit)) for unit in units if unit[0].tag == "ARTICLE"]


def _of_package(files: list[tuple]) -> list[tuple]:
    """(name, pos, act, number, chain, quoted) of a package's clauses; ``files`` are (name, what :func:`_of_document` gave)."""
    scoped = any(act is not None for _, (_, articles) in files for act, _ in articles)
    shipped: dict[str, str] = {}
    for name, (location, _) in files:
        if location is not None:
            shipped.setdefault(name, location)
    out = []
    for name, (_, articles) in files:
        for act, clauses in articles:
            if act is None and scoped:
                continue
            for pos, number, chain, quotes in clauses:
                quoted = [q for q in (place if place is not None else shipped.get(file) for place, file in quotes) if q is not None]
                out.append((name, pos, act, number, [dict(zip(("mark", "clause", "opens"), c)) for c in chain], quoted))
    return out


#: Clauses that leave a task at once.
CLAUSES = 1000


def clauses(docs: DataFrame, key: str, name: str = "name", data: str = "data") -> DataFrame:
    """(key, name, pos, act, number, chain, quoted): the clauses of packages of acts that have none below them; a task holds one package."""
    rows = docs.select(key, name, F.col(data).cast("binary").alias("_data")).dropna(subset=[key, name])
    fields = T.StructType.fromDDL("pos int, act string, number string, chain array<struct<mark:string,clause:string,opens:boolean>>, quoted array<string>")
    schema = T.StructType([rows.schema[key], rows.schema[name], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[tuple] = []
        files: list[tuple] = []
        package = None

        def made(part):
            return pa.RecordBatch.from_arrays([*map(pa.array, zip(*part), arrow.types)], schema=arrow)

        for batch in batches:
            for which, called, blob in zip(*(batch.column(c).to_pylist() for c in (key, name)), batch.column("_data")):
                if which != package:
                    held += [(package, *c) for c in _of_package(files)]
                    package, files = which, []
                    for at in range(0, len(held) - CLAUSES + 1, CLAUSES):
                        yield made(held[at : at + CLAUSES])
                    held = held[len(held) // CLAUSES * CLAUSES :]
                root = well_formed(blob.as_py())
                if root is not None:
                    files.append((called, _of_document(root)))
        held += [(package, *c) for c in _of_package(files)]
        for at in range(0, len(held), CLAUSES):
            yield made(held[at : at + CLAUSES])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few bytes of markup make many clauses
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def read(docs: DataFrame, key: str, name: str = "name", data: str = "data") -> dict[str, DataFrame]:
    """``records`` (key, name, pos, source, location, change, act, from_quotation) and ``unread`` (key, name, pos, source, clause, reason).

    ``docs`` are the documents of acts, a row for each file of a package. If an article of a package names an act, those that name
    none are passed over. An insertion is recorded at each location that it quotes; one that quotes nothing and names a unit only
    amends that unit.
    """
    none = F.array().cast(f"array<{SEGMENT}>")

    def link(c: Column) -> Column:
        silent = c["opens"] & ~verb(c["clause"]).eqNullSafe("amends")
        return F.when(silent, none).otherwise(references.reference_segments(c["clause"]))

    def below(context: Column, named: Column) -> Column:
        absolute = (F.size(named) > 0) & named[0]["code"].isin(*references.TOP)
        return F.when(absolute, named).otherwise(F.concat(context, named))

    own = F.element_at("chain", -1)["clause"]
    marks = F.array_join(F.filter(F.transform("chain", lambda c: c["mark"]), lambda m: m != ""), " ")
    source = F.trim(F.concat_ws(" ", F.lit("AR"), "number", marks))
    place = F.aggregate(F.transform("chain", link), none, below)
    told = clauses(docs, key, name, data).select(key, name, "pos", "act", "quoted", source.alias("source"), own.alias("clause"), verb(own).alias("verb"), place.alias("place"))
    change = F.when(F.col("verb") == "amends", F.lit("modified")).otherwise(F.col("verb"))
    location = F.when(F.size("place") > 0, written(F.col("place")))
    told = told.select(key, name, "pos", "act", "quoted", "source", "clause", change.alias("change"), location.alias("place"), (F.size("place") == 1).alias("top"))

    def outcome(location: Column, change: Column, quoted: bool, reason: Column = F.lit(None)) -> Column:
        fields = {"location": location.cast("string"), "change": change.cast("string"), "from_quotation": F.lit(quoted), "reason": reason.cast("string")}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    inserted = F.coalesce(F.col("change") == "inserted", F.lit(False))
    hint = reduce(lambda x, y: x | y, [F.col("clause").rlike(rf"(?i)\b{h}\b") for h in HINTS])
    reason = F.when(F.col("change").isNull(), F.lit("no instruction verb")).otherwise(F.lit("no provision reference"))
    found = (
        F.when(inserted & (F.size("quoted") > 0), F.transform("quoted", lambda q: outcome(q, F.col("change"), True)))
        .when(F.col("change").isNotNull() & F.col("place").isNotNull(), F.array(outcome(F.col("place"), F.when(inserted & F.col("top"), F.lit("modified")).otherwise(F.col("change")), False)))
        .when(hint, F.array(outcome(F.lit(None), F.lit(None), False, reason)))
    )
    each = told.select(key, name, "pos", "source", "act", "clause", F.inline(found))
    records = each.where("reason IS NULL").select(key, name, "pos", "source", "location", "change", "act", "from_quotation")
    return {"records": records, "unread": each.where("reason IS NOT NULL").select(key, name, "pos", "source", "clause", "reason")}


def claims(records: DataFrame, key: str) -> DataFrame:
    """(act, unit, claimed_kind): what records say of each unit of each act, one kind a unit: the strongest of those told."""
    strength = F.create_map(*[F.lit(x) for pair in (("deleted", 3), ("inserted", 2), ("modified", 1)) for x in pair])
    unit = F.array_join(F.slice(F.split("location", " "), 1, 2), " ")
    deep = F.size(F.split("location", " ")) > 2  # a change inside a unit amends the unit
    kind = F.when(deep, F.lit("modified")).otherwise(F.col("change"))
    return records.where("act IS NOT NULL").select("act", unit.alias("unit"), kind.alias("kind")).groupBy("act", "unit").agg(F.max_by("kind", strength[F.col("kind")]).alias("claimed_kind"))
