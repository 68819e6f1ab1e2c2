"""Provisions out of legal markup: units, located nodes, texts, tables.

A document is flattened to one row an element (:func:`elements`), in document order, with the way down to it. Everything after
that is joins and groups over those rows: which elements are units, which segment an element adds to a location, the texts of
nodes. The places of a unit's nodes are a small fold in Python, grouped. Tables are read a document at a time (:mod:`outline`).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import comparison_text
from ..operators.stages import staged
from . import outline
from .outline import INLINE, DASHES, SKIPPED, UNITS, Places, flattened
from .packages import well_formed

#: Lines of tables that leave a task at once.
LINES = 2000

#: Fixed values of the markup: containers without a location of their own, and elements that may have one.
TRANSPARENT = "CONS.DOC ENACTING.TERMS FINAL CONTENTS DIVISION GR.SEQ LIST ITEM P TXT BLK DLIST DLIST.ITEM DEFINITION".split()
LOCATABLE = "PARAG ALINEA NP GR.SEQ CONS.ANNEX ANNEX".split()
#: First words of a title that heads a division.
DIVISIONS = "CHAPTER PART SECTION SUBSECTION TITLE ANNEX APPENDIX FOREWORD CONTENTS TABLE INTRODUCTION ENTRY".split()

#: Elements whose flat text is looked up by their parent, or for ``TI`` and ``STI`` by the title's parent.
TITLES = ("TI.ART", "STI.ART", "NO.PARAG", "NO.P", "NO.GR.SEQ", "TITLE", "TI", "STI", "TI.BLK")

_ELEMENT = "pos int, end int, parent int, tag string, tags array<string>, up array<int>, attrs map<string,string>, at int, text string, tail_at int, tail string, gap string"


def elements(docs: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """(by, ``_ELEMENT``): one row an element, in document order; a document that isn't well formed has none."""
    rows = docs.select(*by, F.col(data).cast("binary").alias("_data"))
    element = T.StructType.fromDDL(_ELEMENT)
    schema = T.StructType([rows.schema[c] for c in by] + element.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                root = well_formed(batch.column("_data")[at].as_py())
                found = flattened(root) if root is not None else []
                for lo in range(0, len(found), 2000):
                    part = found[lo : lo + 2000]
                    keys = [batch.column(c).take(pa.array([at] * len(part))) for c in by]
                    columns = [pa.array([list(r[i].items()) if i == 6 else r[i] for r in part], arrow.types[len(by) + i]) for i in range(len(element))]
                    yield pa.RecordBatch.from_arrays([*keys, *columns], schema=arrow)

    return rows.mapInArrow(run, schema)


def in_units(rows: DataFrame) -> DataFrame:
    """The elements of units, with ``unit`` (its position) and ``steps`` (the tags from below the unit down to the element).

    A unit is the first unit's tag on the way down, unless the way leads through text or a skipped subtree.
    """
    way, places = F.concat("tags", F.array("tag")), F.concat("up", F.array("pos"))
    first = F.array_min(F.filter(F.transform(way, lambda t, i: F.when(t.isin(*UNITS), i)), lambda i: i.isNotNull()))
    found = rows.withColumns({"_way": way, "_at": first}).where("_at IS NOT NULL")
    clear = ~F.exists(F.slice("_way", 2, F.greatest(F.col("_at") - 1, F.lit(0))), lambda t: t.isin(*INLINE, *SKIPPED))
    found = found.where(clear).withColumns({"unit": F.element_at(places, F.col("_at") + 1), "steps": F.slice("_way", F.col("_at") + 2, 1_000_000)})
    return found.where(~F.exists("steps", lambda t: t.isin(*SKIPPED))).drop("_way", "_at")


def pieces(units: DataFrame, by: list[str], left_out: tuple[str, ...] = ()) -> DataFrame:
    """(by, unit, at, k, piece, owners): the texts of units in order, with the elements that each is part of.

    ``k`` is 0 for what stands before an element that opens a line, 1 for characters of the document. Inside an element of
    ``left_out`` a piece is part of that element and of what is below it, not of what is above.
    """

    def owners(tags: Column, places: Column) -> Column:
        last = F.array_max(F.zip_with(tags, places, lambda t, p: F.when(t.isin(*left_out), p))) if left_out else F.lit(None)
        return F.filter(places, lambda p: p >= F.greatest(F.col("unit"), F.coalesce(last, F.lit(-1))))

    inner = owners(F.concat("tags", F.array("tag")), F.concat("up", F.array("pos")))
    outer = F.when(F.col("pos") != F.col("unit"), owners(F.col("tags"), F.col("up"))).otherwise(F.array().cast("array<int>"))
    text = F.struct(F.col("at").alias("at"), F.lit(1).alias("k"), F.col("text").alias("piece"), inner.alias("owners"))
    tail = F.struct(F.col("tail_at").alias("at"), F.lit(1).alias("k"), F.col("tail").alias("piece"), outer.alias("owners"))
    gap = F.struct(F.col("at").alias("at"), F.lit(0).alias("k"), F.col("gap").alias("piece"), outer.alias("owners"))
    each = units.select(*by, "unit", F.inline(F.array(text, tail, gap)))
    return each.where("piece <> '' AND size(owners) > 0")


def texts_of(found: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, text, comparison_text) of the wanted elements (by, pos): as the document has it, with line breaks where a
    block opens, and with blanks at every element's border, collapsed."""
    owned = found.select(*by, "at", "k", "piece", F.explode("owners").alias("pos")).join(wanted, [*by, "pos"])
    held = owned.groupBy(*by, "pos").agg(F.array_sort(F.collect_list(F.struct("at", "k", "piece"))).alias("p"))
    plain = F.array_join(F.transform(F.filter("p", lambda x: x["k"] == 1), lambda x: x["piece"]), " ")
    return held.select(*by, "pos", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), comparison_text(plain).alias("comparison_text"))


def titles(units: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, title): of each element a map from a child's tag to the flat text of the first such child; below a title as
    ``TITLE/TI`` and ``TITLE/STI``."""
    heads = units.where(F.col("tag").isin(*TITLES)).select(*by, "pos", "tag", "parent", "up", "tags")
    flat = heads.join(texts_of(found, heads.select(*by, "pos"), by).select(*by, "pos", "comparison_text"), [*by, "pos"], "left")
    below = F.try_element_at("tags", F.lit(-1)) == "TITLE"
    inner = F.col("tag").isin("TI", "STI")
    owner = F.when(inner & below, F.try_element_at("up", F.lit(-2))).otherwise(F.col("parent"))
    name = F.when(inner & below, F.concat(F.lit("TITLE/"), "tag")).otherwise(F.col("tag"))
    named = flat.select(*by, owner.alias("pos"), name.alias("_name"), F.col("pos").alias("_p"), F.coalesce("comparison_text", F.lit("")).alias("_t")).where("pos IS NOT NULL")
    first = named.groupBy(*by, "pos", "_name").agg(F.min_by("_t", "_p").alias("_t"))
    return first.groupBy(*by, "pos").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_t"))).alias("title"))


def identifier(raw: Column) -> Column:
    """An identifier attribute as a number: its last dotted part without leading zeros, a letter in small; else null."""
    last = F.substring_index(F.trim(raw), ".", -1)
    digits, letters = F.regexp_extract(last, "^([0-9]+)[A-Za-z]*$", 1), F.regexp_extract(last, "([A-Za-z]*)$", 1)
    return F.when(digits != "", F.concat(F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")), F.lower(letters)))


def _titled(*names: str) -> Column:
    """The first title of these names that an element has; empty if none."""
    return F.coalesce(*[F.try_element_at("title", F.lit(n)) for n in names], F.lit(""))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def annex_number(title: Column, word: str) -> Column:
    """The first number behind ``word`` in a title: a numeral in capitals, or digits with a letter or none."""
    behind = F.regexp_extract_all(F.upper(title), F.lit(rf"\b{word} +(\w+)"), F.lit(1))
    return F.try_element_at(F.filter(behind, lambda w: w.rlike("^([CDILMVX]+|[0-9]+[A-Z]?)$")), F.lit(1))


def section_number(title: Column) -> Column:
    """The number of a section by its title: what stands behind ``Section``, or a dotted number before more words."""
    words = F.split(title, " ")
    named = F.when(words[0].isin("Section", "SECTION"), F.regexp_extract(F.try_element_at(words, F.lit(2)), "^[0-9A-Za-z.]*", 0))
    dotted = F.when((F.size(words) > 1) & words[0].rlike(r"^[0-9]+(\.[0-9]+)*\.$"), words[0])
    return _filled(F.regexp_replace(F.coalesce(_filled(named), dotted), r"\.+$", ""))


def point(marker: Column) -> Column:
    """struct<code,value> of a point by its mark: an indent, a number, or a lettered one, which its list may turn to ``PTI``."""
    bare = F.regexp_replace(F.regexp_replace(marker, r"\.$", ""), r"^\(|\)$", "")
    indent = F.struct(F.lit("TIRE").alias("code"), F.lit(None).cast("string").alias("value"))
    number = F.struct(F.lit("PO").alias("code"), bare.alias("value"))
    letter = F.struct(F.lit("PTA").alias("code"), F.concat(F.lit("("), F.lower(bare), F.lit(")")).alias("value"))
    return F.when(marker == "", None).when(marker.isin(*DASHES), indent).when(bare.rlike("^[0-9]+[A-Za-z]*$"), number).when(bare.rlike("^[0-9A-Za-z]+$"), letter)


def article_number() -> Column:
    """An article's number (attrs, title): by its identifier, or else by its heading."""
    headed = F.regexp_extract(F.lower(_titled("TI.ART")), r"\barticle +([0-9]+ ?[a-z]?)(?!\w)", 1)
    return F.coalesce(identifier(F.col("attrs")["IDENTIFIER"]), _filled(F.replace(headed, F.lit(" "), F.lit(""))))


def segment() -> Column:
    """struct<code,value>: what an element (tag, attrs, title, annex) adds to a location; null if nothing, a null value if it is
    counted among its siblings."""
    number = F.col("attrs")["IDENTIFIER"]

    def of(code: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(code).alias("code"), value.alias("value")))

    def undotted(text: Column) -> Column:
        return _filled(F.regexp_replace(F.trim(text), r"\.+$", ""))

    title = _titled("TITLE/TI", "TITLE")
    article = article_number()
    annex = F.coalesce(of("AN", annex_number(title, "ANNEX")), of("APP", annex_number(title, "APPENDIX")))
    is_unit = F.col("pos") == F.col("unit")
    return (
        F.when(is_unit & (F.col("tag") == "ARTICLE"), of("AR", article))
        .when(is_unit | (F.col("annex") & F.col("tag").isin(*UNITS)), annex)
        .when(F.col("tag") == "PARAG", of("PA", F.coalesce(identifier(number), F.lower(undotted(_titled("NO.PARAG"))))))
        .when(F.col("tag") == "ALINEA", F.struct(F.lit("ALN").alias("code"), F.lit(None).cast("string").alias("value")))
        .when(F.col("tag") == "NP", point(F.trim(_titled("NO.P"))))
        .when(F.col("annex") & (F.col("tag") == "GR.SEQ"), of("SCT", F.coalesce(undotted(_titled("NO.GR.SEQ")), section_number(title))))
    )


def group_subjects(rows: DataFrame, walked: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, subject): the subject of an annex whose whole content is one group without a number: that group's title,
    unless it opens with a word that heads a division."""
    groups = walked.where("tag = 'GR.SEQ' AND code IS NULL").select(*by, F.col("pos").alias("g"), F.col("parent").alias("c"), F.try_element_at("title", F.lit("TITLE/TI")).alias("subject"))
    contents = rows.where("tag = 'CONTENTS'").select(*by, F.col("pos").alias("c"), F.col("parent").alias("pos"))
    alone = rows.join(contents.select(*by, F.col("c").alias("parent")), [*by, "parent"], "left_semi").groupBy(*by, F.col("parent").alias("c")).agg(F.count("*").alias("_n")).where("_n = 1")
    first = contents.groupBy(*by, "pos").agg(F.min("c").alias("c")).join(alone, [*by, "c"], "left_semi")
    word = F.upper(F.regexp_extract("subject", r"^\p{L}+", 0))
    return first.join(groups, [*by, "c"]).where((word != "") & ~word.isin(*DIVISIONS)).select(*by, "pos", "subject")


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """Locations of one unit's elements (pos, parent, tag, list_type, code, value), in document order."""
    places, out = Places(), []
    for r in rows.sort_values("pos").itertuples():
        found = places.add(r.pos, r.parent, r.tag, r.list_type, r.code, r.value)
        if found is not None:
            out.append((int(r.pos), *found))
    return pd.DataFrame(out, columns=["pos", "location", "above"])


def tree(docs: DataFrame, by: list[str], data: str = "data") -> dict[str, DataFrame]:
    """Documents as provisions: ``nodes``, ``unknown``, ``rows`` and ``pieces`` (the elements of units and their texts) and ``docs`` (for :func:`tables`).

    ``nodes``: (by, unit, pos, location, parent, kind, heading, text, comparison_text): a row for each located element, units
    without a parent. A unit without a number has no nodes. ``unknown``: (by, tag, n): tags below units that are neither text,
    nor containers, nor locatable; their text is part of every node above.
    """
    # few bytes of markup make many rows: documents are dealt to all tasks before they are opened
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(in_units(elements(docs.repartition(parts, *by), by, data)))
    found = staged(pieces(rows, by))
    heads = titles(rows, found, by)
    unit_tag = rows.where("pos = unit").select(*by, "unit", (F.col("tag") != "ARTICLE").alias("annex"))
    walked = rows.where(~F.exists("steps", lambda t: t.isin(*INLINE))).join(unit_tag, [*by, "unit"]).join(heads, [*by, "pos"], "left")
    walked = walked.withColumn("_s", segment()).select(*by, "unit", "pos", "parent", "tag", "annex", "title", F.col("attrs")["TYPE"].alias("list_type"), "_s.*")
    numbered = walked.where("pos = unit AND code IS NOT NULL").select(*by, "unit")
    walked = staged(walked.join(numbered, [*by, "unit"], "left_semi"))
    fold = walked.select(*by, "unit", "pos", F.when(F.col("pos") != F.col("unit"), F.col("parent")).alias("parent"), "tag", "list_type", "code", "value")
    keys = [*by, "unit"]
    placed_schema = T.StructType([fold.schema[c] for c in keys] + [T.StructField("pos", T.IntegerType()), T.StructField("location", T.StringType()), T.StructField("parent", T.StringType())])

    def places(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        out = _placed(rows_).rename(columns={"above": "parent"})
        for name, value in reversed(list(zip(keys, key))):
            out.insert(0, name, value)
        return out

    placed = staged(fold.repartition(parts, *keys).groupBy(*keys).applyInPandas(places, placed_schema))
    told = placed.join(texts_of(found, placed.select(*by, "pos"), by), [*by, "pos"], "left").join(walked.select(*by, "pos", "tag", "title"), [*by, "pos"])
    told = told.join(group_subjects(rows, walked, by), [*by, "pos"], "left")
    heading = (
        F.when(F.col("tag") == "ARTICLE", _filled(_titled("STI.ART", "TI.ART")))
        .when(F.col("tag").isin("ANNEX", "CONS.ANNEX"), F.coalesce(F.try_element_at("title", F.lit("TITLE/STI")), "subject", _titled("TITLE/TI")))
        .when(F.col("tag") == "GR.SEQ", _filled(_titled("TITLE/TI")))
    )
    kind = F.element_at(F.split("location", " "), -2)
    empty = F.lit("")
    nodes = told.select(*by, "unit", "pos", "location", "parent", kind.alias("kind"), _filled(heading).alias("heading"), F.coalesce("text", empty).alias("text"), F.coalesce("comparison_text", empty).alias("comparison_text"))
    unknown = walked.where(~F.col("tag").isin(*TRANSPARENT, *LOCATABLE, *UNITS)).groupBy(*by, "tag").agg(F.count("*").alias("n"))
    return {"nodes": nodes, "unknown": unknown, "rows": rows, "pieces": found, "docs": docs.select(*by, F.col(data).alias("data"))}


def tables(made: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """The lines of every table of the units of a :func:`tree`."""
    return table_lines(made["docs"], by, "data")


def table_lines(docs: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """(by, unit, container, table, row, header, heading, cells, marks): the lines of every table of the numbered units of documents.

    ``container`` is the location of the node that a table stands in, ``table`` its number there; a table inside a table is part of
    the outer one. ``heading`` is the title of the innermost block around a row. A task reads a document as a whole, so nothing is
    shuffled; documents are as the caller has dealt them.
    """
    rows = docs.select(*by, F.col(data).cast("binary").alias("_data"))
    line = T.StructType.fromDDL("unit int, container string, table int, row int, header boolean, heading string, cells array<string>, marks array<string>")
    schema = T.StructType([rows.schema[c] for c in by] + line.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            from_doc: list[int] = []
            held: list[tuple] = []

            def made():
                keys = [batch.column(c).take(pa.array(from_doc, pa.int64())) for c in by]
                return pa.RecordBatch.from_arrays([*keys, *map(pa.array, zip(*held), arrow.types[len(by) :])], schema=arrow)

            for at, blob in enumerate(batch.column("_data")):
                root = well_formed(blob.as_py())
                for found in outline.table_lines(root) if root is not None else ():
                    from_doc.append(at)
                    held.append(found)
                    if len(held) == LINES:
                        yield made()
                        from_doc, held = [], []
            if held:
                yield made()

    return rows.mapInArrow(run, schema)
