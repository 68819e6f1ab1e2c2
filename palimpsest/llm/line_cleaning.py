"""Line-first cleaning (operator 11), all in DataFrame functions.

Every line of a text is judged alone: a line without a final punctuation mark, a line of navigation (cells between
separators, or nothing but menu words) and a line of boilerplate go. What is left is the cleaned text, and a document that
lost more than ``MOST_LOST`` percent of its characters in words is rejected, as is one that fails the base rules (too few
words, or too many of them in repeated windows of three words).

A text stays in its row and nothing is shuffled, so a hot source or group of copies costs its own rows. Arrays of a row are
as long as its text; windows are compared by a hash first, and only texts in which a hash repeats sort their windows.

Defined results: a null text has no words and no lines and fails the base rules, as an empty one does; a line without a
word is neither judged nor counted and stays in the cleaned text; repeated rows are judged alike, each on its own; null
ids are carried; other columns, whatever their names, are carried by :func:`cleaned` and ignored otherwise; an empty table
gives an empty result. A word or line of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Symbols that the base counts, marks that end a sentence, marks that may follow them, separators of cells.
SYMBOLS = "#*$%&|<>"
ENDS = r"[.!?…。！？؟।]"
CLOSERS = r"\x22')\]”’»"
SEPARATORS = "|>»›·•→"

#: Words of menus, and phrases of notices that don't belong to a text, in small letters.
MENU = (
    "home menu search login logout register subscribe share print email next previous prev back top "
    "about contact help faq sitemap archive archives categories tags comments reply newsletter rss "
    "startseite suche anmelden kontakt impressum weiter zurück accueil recherche connexion suivant précédent "
    "inicio buscar contacto siguiente anterior"
).split()
NOTICES = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "terms and conditions",
    "privacy policy", "cookie policy", "use of cookies", "uses cookies", "accept cookies", "enable javascript", "lorem ipsum",
    "powered by", "click here", "read more", "sign up for our", "subscribe to our", "alle rechte vorbehalten", "tous droits réservés",
    "todos los derechos reservados",
]

#: Production parameters: fewest words, most words in repeated windows (percent of all), most characters lost to
#: removed lines (percent), most words a cell of navigation has on average, and the longest line read as a menu.
LEAST_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 30
CELL_WORDS = 6
MENU_CHARS = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDED = f"{ENDS}[{CLOSERS}\\x20\\x09-\\x0D]*\\z"
_NOTICE = "|".join(NOTICES)
_CELLS = f"{SPACE}[{SEPARATORS}]({SPACE}|\\z)"
_MENU = f"\\A({SPACE}|[,;:.|/>]|({'|'.join(MENU)})({SPACE}|[,;:.|/>]|\\z))+\\z"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long")


def line_rule(line: Column) -> Column:
    """The first rule that a line with a word fails: 'boilerplate', 'navigation' or 'punctuation'; null if none."""
    low = F.translate(line, UPPER, LOWER)
    words = words_of(line)
    cells = F.size(F.filter(words, lambda w: (F.char_length(w) == 1) & F.lit(SEPARATORS).contains(w)))
    table_row = F.when(line.rlike(_CELLS), (cells >= 2) & (F.size(words) - cells <= CELL_WORDS * (cells + 1))).otherwise(F.lit(False))
    menu = F.when(F.char_length(line) <= MENU_CHARS, low.rlike(_MENU)).otherwise(F.lit(False))
    return (
        F.when(low.rlike(_NOTICE), F.lit("boilerplate"))
        .when(table_row | menu, F.lit("navigation"))
        .when(~line.rlike(_ENDED), F.lit("punctuation"))
    )


def line_verdicts(text: Column) -> Column:
    """For each line of a text (line, rule): the rule that it fails, null for lines that stay."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    return F.transform(lines, lambda line: F.struct(line.alias("line"), F.when(line.rlike(WORD), line_rule(line)).alias("rule")))


def _window_hashes(words: str) -> Column:
    """A hash for each window of three words, in order."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(at, lambda i: F.xxhash64(F.col(words)[i], F.col(words)[i + 1], F.col(words)[i + 2]))
    return F.when(F.size(words) >= 3, windows).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(words: str, hashes: str) -> Column:
    """The windows as (hash, words, place), equal ones side by side; null unless a hash repeats."""
    rows = F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), *[F.col(words)[i + k].alias(f"w{k}") for k in range(3)], i.alias("at")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(rows))


def _repeated_places(windows: str) -> Column:
    """The places, ascending, of windows found twice or more."""
    rows, last = F.col(windows), F.size(windows) - 1

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])

    def place(x: Column, k: Column) -> Column:
        before = F.when(k > 0, same(x, rows[F.greatest(k - 1, F.lit(0))])).otherwise(F.lit(False))
        after = F.when(k < last, same(x, rows[F.least(k + 1, last)])).otherwise(F.lit(False))
        return F.when(before | after, x["at"])

    return F.sort_array(F.filter(F.transform(rows, place), lambda at: at.isNotNull()))


def _covered(places: str) -> Column:
    """How many words windows of three at these places cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    total = F.aggregate(places, start, lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")))
    return F.coalesce(total["n"], F.lit(0)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_m``: the base counts, the cleaned text, what it lost and both verdicts."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    out = out.withColumn("_hashes", _window_hashes("_words")).withColumn("_windows", _sorted_windows("_words", "_hashes"))
    out = out.withColumn("_places", _repeated_places("_windows")).withColumn("_lines", line_verdicts(F.col("_text")))
    kept = F.filter("_lines", lambda x: x["rule"].isNull())
    out = out.withColumn("_left", F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    lines = F.transform(F.filter("_lines", lambda x: x["line"].rlike(WORD)), lambda x: x["line"])
    out = out.withColumn("_worded", lines)
    out = out.withColumn(
        "_c",
        F.struct(
            F.size("_words").cast("long").alias("n_words"),
            word_chars(F.col("_text")).alias("word_chars"),
            (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
            _covered("_places").alias("n_repeat_words"),
            F.size("_worded").cast("long").alias("n_lines"),
            F.size(F.filter("_lines", lambda x: x["rule"].isNotNull())).cast("long").alias("n_removed_lines"),
            word_chars(F.col("_left")).alias("left_chars"),
        ),
    )
    base = (F.col("_c.n_words") < LEAST_WORDS) | (100 * F.col("_c.n_repeat_words") > MOST_REPEATED * F.col("_c.n_words"))
    lost = 100 * (F.col("_c.word_chars") - F.col("_c.left_chars")) > MOST_LOST * F.col("_c.word_chars")
    whole = F.struct(F.col("_left").alias("text"), "_c.*", base.alias("base_failed"), (~base & ~lost).alias("kept"))
    return out.select(*[docs[c] for c in docs.columns], whole.alias("_m"))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, every column as it was but the text, which is cleaned."""
    # all columns in one, so that none can clash with those of the measures
    held = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("_row"), docs[text_col].alias("_source"))
    done = measured(held, "_source").where("_m.kept")
    return done.select(*[(F.col("_m.text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the base counts, lines judged and removed, characters left, and the verdicts."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "left_chars"]
    return measured(narrow).select("doc_id", *[F.col(f"_m.{c}").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: DuckDB: words, lines and windows as rows, counted by grouping.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d)
), g AS (
  SELECT r, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), hit AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM hit, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), nw AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r
), l AS (
  SELECT r, line, translate(line, '{UPPER}', '{LOWER}') AS low, regexp_extract_all(line, '{WORD}') AS ws
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')
), c AS (
  SELECT *, len(list_filter(ws, lambda x: length(x) = 1 AND contains('{SEPARATORS}', x))) AS cells,
         list_sum(list_transform(ws, lambda x: length(x))) AS chars
  FROM l
), judged AS (
  SELECT r, line, chars,
         regexp_matches(low, '{_NOTICE}')
         OR (cells >= 2 AND len(ws) - cells <= {CELL_WORDS} * (cells + 1))
         OR (length(line) <= {MENU_CHARS} AND regexp_matches(low, '{_MENU}'))
         OR NOT regexp_matches(line, '{_ENDED.replace("'", "''")}') AS bad
  FROM c
), ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (bad) AS n_removed_lines, coalesce(sum(chars) FILTER (NOT bad), 0) AS left_chars
  FROM judged GROUP BY r
), m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(left_chars, 0)::BIGINT AS left_chars
  FROM d LEFT JOIN nw USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)
)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
       AND 100 * (word_chars - left_chars) <= {MOST_LOST} * word_chars AS kept
FROM m
"""
