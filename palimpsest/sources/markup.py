"""Markup as a source: comparison text of HTML, nodes of XML, grids of tables."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparison_text

#: Cells above this are refused, so a broken span can't fill memory.
MOST_CELLS = 1_000_000


def comparison_of_markup(html: Column) -> Column:
    """The text between tags, a blank for each tag, in comparison form."""
    return comparison_text(F.regexp_replace(html, "<[^>]*>", " "))


def expand_grid(rows: list[list[dict]]) -> list[list[str | None]]:
    """A table's cells by place: a cell with ``rowspan`` or ``colspan`` covers the places it spans: its text
    is copied down, and stands once across.

    ``rows`` has cells ``{text, col?, rowspan?, colspan?}``; ``col`` counts from 1 and else follows on.
    """
    covered: dict[tuple[int, int], str | None] = {}
    width = 0
    for y, row in enumerate(rows):
        x = 0
        for cell in row:
            if cell.get("col"):
                x = int(cell["col"]) - 1
            while (y, x) in covered:
                x += 1
            down, across = int(cell.get("rowspan") or 1), int(cell.get("colspan") or 1)
            if len(covered) + down * across > MOST_CELLS:
                raise ValueError("a table with too many cells")
            for dy in range(min(down, len(rows) - y)):
                for dx in range(across):
                    covered[y + dy, x + dx] = cell["text"] if dx == 0 else None
            x += across
            width = max(width, x)
    return [[covered.get((y, x)) for x in range(width)] for y in range(len(rows))]


def _walk(element, parent: str | None, depth: int, seen: dict[str, int], out: list[tuple]) -> None:
    name = element.get("id") or element.tag
    base = f"{parent} {name}" if parent else name
    seen[base] = seen.get(base, 0) + 1
    location = base if seen[base] == 1 else f"{base}#{seen[base]}"
    heading = element.findtext("heading")
    out.append((len(out), parent, location, depth, heading, "".join(element.itertext())))
    for child in element:
        if child.tag != "heading" and isinstance(child.tag, str):
            _walk(child, location, depth + 1, seen, out)


def xml_nodes(documents: DataFrame, key: str, markup: str = "xml") -> DataFrame:
    """(key, state, pos, parent, location, depth, heading, text): one row per element, in document order.

    Locations are unique: a repeat gets its number. A document that isn't well formed is one row with
    the state ``unreadable``; one that is has ``read``.
    """
    node = "array<struct<pos:int,parent:string,location:string,depth:int,heading:string,text:string>>"

    @F.pandas_udf(node)
    def parse(column):
        import pandas as pd

        def one(text):
            try:
                root = ElementTree.fromstring(text)
            except (ElementTree.ParseError, TypeError):
                return None
            out: list[tuple] = []
            _walk(root, None, 0, {}, out)
            names = ("pos", "parent", "location", "depth", "heading", "text")
            return [dict(zip(names, row)) for row in out]

        return pd.Series([one(t) for t in column])

    parsed = documents.select(key, parse(markup).alias("nodes"))
    rows = parsed.select(key, F.when(F.col("nodes").isNull(), F.lit("unreadable")).otherwise(F.lit("read")).alias("state"), F.explode_outer("nodes").alias("n"))
    return rows.select(key, "state", "n.*")
