"""Keys and names of table rows, read from a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import index_check
from .text import comparison_text, hyphens

#: What an empty cell holds, and the longest name in characters.
EMPTY = ("", "-", "/", "–", "—")
NAME_CHARS = 60


def first_line(cell: Column) -> Column:
    return F.trim(F.split_part(F.regexp_replace(cell, r"^\s+", ""), F.lit("\n"), F.lit(1)))


def _key(key: Column, failed: Column | None = None) -> Column:
    return F.struct(key.alias("key"), (F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))).alias("failed"))


def index_key(cell: Column) -> Column:
    """struct<key,failed>: the index number that a cell begins with; ``failed`` if its check sign doesn't hold."""
    text = hyphens(comparison_text(cell))
    lead = F.regexp_extract(text, r"^([0-9]{3}-[0-9]{3}-[0-9]{2}-[0-9X])(?![0-9-])", 1)
    body = F.replace(F.substring(lead, 1, 10), F.lit("-"), F.lit(""))
    holds = (lead != "") & (index_check(body) == F.substring(lead, 12, 1))
    return _key(F.when(holds, lead), (lead != "") & ~holds)


def number_key(cell: Column) -> Column:
    """struct<key,failed>: the entry number that a cell begins with, or else the cell."""
    text = comparison_text(cell)
    lead = F.regexp_extract(text, "^([0-9]+[a-z]?)([. ]|$)", 1)
    return _key(F.when(~text.isin(*EMPTY), F.coalesce(F.nullif(lead, F.lit("")), text)))


def text_key(cell: Column) -> Column:
    """struct<key,failed>: the whole cell."""
    text = comparison_text(cell)
    return _key(F.when(~text.isin(*EMPTY), text))


def name_key(cell: Column) -> Column:
    """struct<key,failed>: the first line without footnote marks that stand alone and stars at its end, in small letters."""
    words = F.filter(F.split(comparison_text(first_line(cell)), " "), lambda w: ~w.isin("(#)", "(+)", "(*)", "(**)"))
    line = comparison_text(F.regexp_replace(F.array_join(words, " "), r"\*+$", ""))
    return _key(F.when(~line.isin(*EMPTY), F.lower(line)))


#: Key readers by the form that a table's profile names.
READERS = {"index": index_key, "number": number_key, "text": text_key, "name": name_key}


def read_key(cell: Column, form: Column) -> Column:
    """struct<key,failed> of a cell by the form of its table; null for an unknown form."""
    out = F.lit(None)
    for name, reader in READERS.items():
        out = F.when(form == name, reader(cell)).otherwise(out)
    return out


def entry_name(cell: Column, drop_number: bool = False) -> Column:
    """The first line of a name's cell, without its entry number if asked; null if nothing is left."""
    line = first_line(cell)
    return F.nullif(F.regexp_replace(line, r"^[0-9]+[a-z]?\.?\s*", "") if drop_number else line, F.lit(""))


def row_name(name: Column, most: int = NAME_CHARS) -> Column:
    """A row's name as a sentence shows it: up to a semicolon, and above ``most`` characters cut behind a whole word, with dots."""
    text = F.trim(F.split_part(name, F.lit(";"), F.lit(1)))
    whole = F.regexp_extract(F.substring(text, 1, most + 1), "^(.*) ", 1)
    cut = F.when(whole != "", whole).otherwise(F.substring(text, 1, most))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,]+$", ""), F.lit("…")))
