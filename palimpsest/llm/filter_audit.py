"""Interaction of filters, audited for every order in which they can run (operator 12).

Each document gets one failure flag for each filter, and documents are counted by part and flags. A CUBE over the flags and
the part then gives, in the grouping sets whose selected flags are all false, how many documents a subset of the filters
leaves. A filter that runs after some others removes the difference of two such counts, so every step of every order is a
join of a pair of subsets, and no order is ever run over the documents.

The documents are read once. Texts become flags and a digest in the rows they came in; copies are found by the digest, of
which only those that occur twice go on, so a text held by a third of all rows is one partly aggregated row for each task and
one row to join (the optimizer splits the other side). What the CUBE reads has at most 32 rows a part.

Defined results: a null text is empty (no words, so it fails A, and not B or C); a null part is the empty string, and falls
together with an empty one; a null id is no smaller than any and none is smaller than it, so such a row never fails E;
rows repeated with their id don't fail E for each other, and each counts; labels of an id are its largest ones, nulls and
labels of unknown documents are passed by; an empty table has no part and gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import staged, table
from .line_cleaning import words_of

#: The filters, in the order of their bits, and their production parameters.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = "[#$%&*|]"

COUNTS = ("n", "good", "toxic")


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions that a text has by itself."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of every row: true where it fails that filter."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    digest = F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").alias("size"))
    narrow = staged(rows.select("doc_id", "part", *[f.alias(k) for k, f in text_flags(F.col("text"), F.col("words")).items()], digest.alias("digest")))
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return narrow.join(first, "digest", "left").select("doc_id", "part", "A", "B", "C", "D", late.alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: whether its document is labelled so."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"), labels["toxic"].cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("_toxic"))
    out = rows.join(known, "doc_id", "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(c) == 1, F.lit(False)).cast("long").alias(name) for c, name in (("quality", "good"), ("_toxic", "toxic"))])


def subset_survivors(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic): what is left of a part by each subset of the filters, zero counts left out.

    Bit i of ``subset`` stands for filter i. The row of the empty subset has all of the part.
    """
    held = rows.groupBy("part", *filters).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    level = F.grouping_id().alias("level")
    cube = held.cube("part", *filters).agg(level, *[F.sum(c).alias(c) for c in COUNTS])
    # of level the highest bit is the part's and the lowest the last filter's; a set bit marks a column that is summed over
    chosen = [F.col("level").bitwiseAND(F.lit(1 << (len(filters) - 1 - i))) == 0 for i in range(len(filters))]
    survives = F.col("level") < F.lit(1 << len(filters))
    for c, name in zip(chosen, filters):
        survives = survives & (~c | ~F.col(name))
    subset = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(chosen)), F.lit(0))
    return cube.where(survives).select("part", subset.cast("int").alias("subset"), *COUNTS)


#: A step of an order: its filter, and the subsets of filters before it, after it, and of it alone.
STEP = {"filter_order": "string", "step": "int", "filter": "string", "before": "int", "after": "int", "alone": "int"}


def steps(filters: str = FILTERS) -> list[tuple[str, int, str, int, int, int]]:
    """Every step of every order, as ``STEP``."""
    out = []
    for order in permutations(filters):
        before = 0
        for k, name in enumerate(order, 1):
            alone = 1 << filters.index(name)
            out.append(("".join(order), k, name, before, before | alone, alone))
            before |= alone
    return out


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of flagged and labelled rows: one row for each part, order and step."""
    # parts x 32 rows, written once: each is read in six joins
    left = staged(subset_survivors(rows, filters))
    parts = left.where("subset = 0").select("part")
    full = (1 << len(filters)) - 1
    every = F.lit(json.dumps([dict(zip(STEP, s)) for s in steps(filters)]))
    plan = parts.select("part", F.inline(F.from_json(every, f"array<struct<{', '.join(f'{c}: {kind}' for c, kind in STEP.items())}>>")))
    plan = plan.withColumns({"others": F.lit(full) - F.col("alone"), "all": F.lit(full), "none": F.lit(0)})
    for at in ("before", "after", "alone", "others", "all", "none"):
        side = left.select(F.col("part"), F.col("subset").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in COUNTS])
        plan = plan.join(side, ["part", at], "left")
    plan = plan.fillna(0, [f"{c}_{at}" for c in COUNTS for at in ("before", "after", "alone", "others", "all", "none")])
    removed = F.col("n_before") - F.col("n_after")
    out = plan.select(
        "part",
        "filter_order",
        "step",
        F.col("n_after").alias("kept"),
        removed.alias("removed"),
        (F.col("n_none") - F.col("n_alone") - removed).alias("redundant"),
        (F.col("n_others") - F.col("n_all")).alias("unique_fails"),
        (F.col("good_before") - F.col("good_after")).alias("good_lost"),
        (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
        "filter",
    )
    total = F.sum("removed").over(Window.partitionBy("part", "filter"))  # as many rows as there are orders
    return out.withColumn("shapley", total).drop("filter")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(table(spark, sf_dir, "documents"))
    return audit(with_labels(rows, table(spark, sf_dir, "labels")))


#: DuckDB: every order applied, step by step, to the counts by part and failed filters.
ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT t.doc_id, part,
    CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS filter, left(filter_order, step - 1) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), x AS (
  SELECT h.*, s.*, contains(fails, filter) AS hit,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: contains(fails, c) AND contains(earlier, c))) > 0 AS gone
  FROM h, s
), r AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = filter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, filter
)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
