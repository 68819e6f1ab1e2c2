"""Rows of tables as keyed entries, and their difference between two versions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparison_text, hyphens

def folded(text: Column) -> Column:
    """A cell in compatibility form without combining marks, dashes alike, and without white space; only labels an amendment."""

    def plain(cells: pd.Series) -> pd.Series:
        def one(cell):
            if cell is None:
                return None
            return "".join(c for c in unicodedata.normalize("NFKD", cell) if not c.isspace() and not unicodedata.combining(c))

        return cells.map(one, na_action="ignore")

    return F.pandas_udf(plain, "string")(hyphens(comparison_text(text)))


def body_rows(rows: DataFrame, table: list[str], line: str, header: Column, blank: Column) -> DataFrame:
    """``rows`` without header rows, repeats of a header's line in the same table, and blank rows."""
    repeats = F.bool_or(header).over(Window.partitionBy(*table, line)) & F.col(line).isNotNull()
    return _dealt(rows, table).withColumn("_heads", repeats).where(~header & ~blank & ~F.col("_heads")).drop("_heads")


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` dealt by ``by`` once, so windows and groups by it and more keys need no shuffle of their own."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def grouped(rows: DataFrame, table: list[str], key: str, order: list[str], cells: list[str]) -> DataFrame:
    """One row per entry (table, key, occurrence): a row whose key is that of the row before continues its entry."""
    w = Window.partitionBy(*table).orderBy(*order)
    begins = F.coalesce(F.lag(key).over(w) != F.col(key), F.lit(True)).cast("int")
    numbered = rows.withColumn("_entry", F.sum(begins).over(w))
    cell = F.struct(*order, *cells)
    held = numbered.groupBy(*table, key, "_entry").agg(F.array_sort(F.collect_list(cell)).alias("rows"))
    occurrence = F.row_number().over(Window.partitionBy(*table, key).orderBy("_entry"))
    return held.withColumn("occurrence", occurrence).withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in cells]))).drop("_entry")


def of_lines(lines: DataFrame, table: list[str], key_col: int = 1) -> DataFrame:
    """(table, key, occurrence, rows) of the lines of grids (table, row, header, cells, marks), told by the key's column.

    Header lines, repeats of one and blank lines are left out. A line whose key is a copy from further up continues the entry
    before it, any other begins one; a key that isn't the line's own is null. ``rows`` holds cells as they are, null where a line has
    none of its own. Keys are compared in comparison form; the k-th entry of a key has occurrence k.
    """
    flat = F.transform("cells", comparison_text)
    shown = lines.withColumn("_line", F.to_json(flat))
    body = body_rows(shown, table, "_line", F.col("header"), F.forall("cells", lambda c: comparison_text(c) == ""))
    at = F.col("marks")[key_col - 1]
    w = Window.partitionBy(*table).orderBy("row")
    begins = ((at != "R") | (F.row_number().over(w) == 1)).cast("int")
    numbered = body.withColumn("_begins", begins).withColumn("_entry", F.sum("_begins").over(w))
    own = F.transform(F.arrays_zip("cells", "marks"), lambda c: F.when(c["marks"] == "", c["cells"]))
    row = F.struct("row", own.alias("cells"), F.when(at == "", comparison_text(F.col("cells")[key_col - 1])).alias("key"))
    held = numbered.groupBy(*table, "_entry").agg(F.array_sort(F.collect_list(row)).alias("r"))
    keyed = held.select(*table, "_entry", F.col("r")[0]["key"].alias("key"), F.transform("r", lambda x: x["cells"]).alias("rows"))
    return keyed.withColumn("occurrence", F.row_number().over(Window.partitionBy(*table, "key").orderBy("_entry"))).drop("_entry")


def difference(old: DataFrame, new: DataFrame, table: list[str], key: str, value: str) -> DataFrame:
    """(table, key, occurrence, change, typography_only) of keyed entries (table, key, occurrence, value).

    Entries pair by occurrence. A key that occurs another number of times on either side is ``unpaired``
    and told once, as occurrence 0. ``value`` is compared as it is, then without spacing, then folded.
    """
    group = [*table, key]

    def side(entries: DataFrame, name: str) -> DataFrame:
        return entries.select(*group, "occurrence", F.lit(name).alias("_side"), F.col(value).alias("_value"))

    rows = _dealt(side(old, "old").unionByName(side(new, "new")).dropna(subset=group), group)
    told = [f(F.when(F.col("_side") == s, x)).alias(f"{name}{s}") for s in ("old", "new") for f, x, name in ((F.max, F.col("_value"), ""), (F.count, F.lit(1), "n_"))]
    both = rows.groupBy(*group, "occurrence").agg(*told)
    for s in ("old", "new"):
        both = both.withColumn(f"k_{s}", F.nullif(F.sum(f"n_{s}").over(Window.partitionBy(*group)), F.lit(0).cast("long")))
    same, spaced = (f(F.col("old")) == f(F.col("new")) for f in (lambda c: c, comparison_text))
    change = (
        F.when(F.col("k_new").isNull(), F.lit("removed")).when(F.col("k_old").isNull(), F.lit("added")).when(F.col("k_old") != F.col("k_new"), F.lit("unpaired"))
        .when(same, F.lit("unchanged")).when(spaced, F.lit("whitespace")).otherwise(F.lit("amended"))
    )
    told = both.withColumn("change", change)
    amended = {side: folded(F.when(F.col("change") == "amended", F.col(side))) for side in ("old", "new")}  # other cells aren't folded
    told = told.withColumn("typography_only", F.coalesce(amended["old"] == amended["new"], F.lit(False)))
    told = told.where("change <> 'unpaired' OR occurrence = 1")
    return told.select(*group, F.when(F.col("change") == "unpaired", 0).otherwise(F.col("occurrence")).cast("int").alias("occurrence"), "change", "typography_only")
