"""Queries on texts: containment, markup, similarity, differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import comparison_text, digest
from ..operators import similarity, texts, versions
from ..operators.stages import staged
from ..sources.markup import comparison_of_markup
from . import fixtures
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_C = r"trim(regexp_replace({t}, '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(' ' || {_C.format(t='d.text')} || ' ', ' ' || {_C.format(t='b.text')} || ' ')")
def quote_containment(spark, sf_dir):
    return texts.quoted(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(f"SELECT page_id, length(c) AS n_chars, sha256(c) AS digest FROM (SELECT page_id, {_C.format(t=chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']))} AS c FROM pages)")
def markup_strip(spark, sf_dir):
    c = comparison_of_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(c).cast("long").alias("n_chars"), digest(c).alias("digest"))


def _neighbours(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs.select(F.lag("doc_id").over(w).alias("left"), F.col("doc_id").alias("right")).where("left IS NOT NULL")


@query(
    rf"""WITH p AS (SELECT lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS l, doc_id AS r FROM documents),
t AS (SELECT doc_id, CASE WHEN c = '' THEN [] ELSE string_split(c, ' ') END AS ws FROM (SELECT doc_id, {_C.format(t='text')} AS c FROM documents)),
n AS (SELECT doc_id, len(ws) AS n FROM t), w AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS word FROM t) GROUP BY 1, 2),
m AS (SELECT p.l, p.r, sum(least(a.k, b.k)) AS m FROM p JOIN w a ON a.doc_id = p.l JOIN w b ON b.doc_id = p.r AND b.word = a.word GROUP BY 1, 2)
SELECT p.l AS "left", p.r AS "right", round(2.0 * least(x.n, y.n) / (x.n + y.n)::DOUBLE, 9) AS real_quick, round(2.0 * coalesce(m.m, 0) / (x.n + y.n)::DOUBLE, 9) AS quick
FROM p JOIN n x ON x.doc_id = p.l JOIN n y ON y.doc_id = p.r LEFT JOIN m ON m.l = p.l AND m.r = p.r WHERE p.l IS NOT NULL AND x.n + y.n > 0"""
)
def similarity_bounds(spark, sf_dir):
    found = similarity.bounds(_neighbours(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id")
    return found.withColumns({c: F.round(c, 9) for c in ("real_quick", "quick")})


@query(
    rf"""WITH n AS (SELECT lang, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS n FROM (SELECT lang, {_C.format(t='text')} AS c FROM documents))
SELECT lang, count(*) AS n_nodes, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n)::BIGINT AS most FROM n GROUP BY 1"""
)
def token_percentiles(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("lang", F.size(similarity.words(F.col("text"))).cast("long").alias("n"))
    quantiles = {f"p{int(q * 100)}": F.round(F.percentile("n", F.lit(q)), 6) for q in (0.5, 0.9, 0.99)}
    return n.groupBy("lang").agg(F.count("*").alias("n_nodes"), *[v.alias(k) for k, v in quantiles.items()], F.max("n").alias("most"))


#: Ratio from which two provisions are twins.
TWIN_FLOOR = 0.90


def twins(docs, floor: float = TWIN_FLOOR):
    """(left, right, ratio): near-identical documents of two sources, each other's best.

    Equal texts of one source are pooled in the smallest id; equal texts of two sources are twins of ratio 1.
    A null text or id has no twin.
    """
    docs = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").withColumn("digest", digest(comparison_text(F.col("text"))))
    pools = docs.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"))
    pools = staged(docs.join(pools, ["digest", "source", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "source", "digest", comparison_text(F.col("text")).alias("t")).withColumn("row", F.monotonically_increasing_id()))
    near = similarity.candidates(pools, "row", "source", "t", floor)
    # ids and digests first: of pairs that stay, texts move
    for side in ("left", "right"):
        near = near.join(pools.select(F.col("row").alias(side), F.struct("doc_id", "digest", "row").alias(f"{side}_of")), side)
    ordered = F.col("left_of.doc_id") < F.col("right_of.doc_id")
    near = near.where("left_of.digest <> right_of.digest").select(F.when(ordered, F.col("left_of")).otherwise(F.col("right_of")).alias("l"), F.when(ordered, F.col("right_of")).otherwise(F.col("left_of")).alias("r"))
    ratios = similarity.paired_ratios(staged(near.select(F.col("l.row").alias("left"), F.col("r.row").alias("right"))), pools, "row", "t", floor)
    name = pools.select("row", "doc_id")
    scored = ratios.withColumnsRenamed({"left": "a", "right": "b"}).join(name.toDF("a", "left"), "a").join(name.toDF("b", "right"), "b").select("left", "right", "ratio")
    equal = similarity.equal_pairs(pools, "doc_id", "digest").withColumn("ratio", F.lit(1.0))
    return similarity.mutual_best(scored.unionByName(equal), floor)


@query()
def twin_pairs(spark, sf_dir):
    return twins(table(spark, sf_dir, "documents"))


def modified_texts(spark, sf_dir):
    """(act, location, old, new) of the units that the second version amends."""
    before, after = fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir)
    modified = versions.diff_units(before, after).where("change_type = 'modified'").select("act", "location")
    old = before.join(modified, ["act", "location"], "left_semi").select("act", "location", F.col("text").alias("old"))
    new = after.join(modified, ["act", "location"], "left_semi").select("act", "location", F.col("text").alias("new"))
    return old.join(new, ["act", "location"])


@query()
def word_diff_spans(spark, sf_dir):
    spans = modified_texts(spark, sf_dir).select("act", "location", F.posexplode(similarity.diff_spans("old", "new")).alias("span", "s"))
    return spans.select("act", "location", "span", "s.kind", F.char_length("s.before").alias("n_before"), F.char_length("s.after").alias("n_after"), F.when(F.col("s.kind") != "equal", F.col("s.after")).alias("after"))


def _left_over(spark, sf_dir):
    before, after = fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir)
    delta = versions.with_renumbered(versions.diff_units(before, after)).select("act", "location", "change_type")
    old = before.join(delta.where("change_type = 'deleted'"), ["act", "location"]).select("act", "location", "change_type", "text")
    return old.unionByName(after.join(delta.where("change_type = 'inserted'"), ["act", "location"]).select("act", "location", "change_type", "text"))


@query()
def renumber_fuzzy(spark, sf_dir):
    return texts.fuzzy_renumberings(_left_over(spark, sf_dir))


@query(
    rf"""WITH {fixtures.RENUMBERED_SQL}, l AS (SELECT d.act, d.change_type, {_C.format(t="coalesce(y.text, x.text)")} AS c FROM delta2 d LEFT JOIN a x ON d.change_type = 'deleted' AND x.act = d.act AND x.location = d.location LEFT JOIN b y ON d.change_type = 'inserted' AND y.act = d.act AND y.location = d.location WHERE d.change_type IN ('deleted', 'inserted')),
s AS (SELECT act, count(*) FILTER (change_type = 'deleted') AS n_deleted, count(*) FILTER (change_type = 'inserted') AS n_inserted FROM l WHERE length(c) >= 100 GROUP BY 1)
SELECT act, n_deleted, n_inserted FROM s WHERE NOT (n_deleted BETWEEN 1 AND 50 AND n_inserted BETWEEN 1 AND 50)"""
)
def renumber_fuzzy_skipped(spark, sf_dir):
    """Acts that fuzzy re-keying passes over, and what they have on each side."""
    return texts.fuzzy_units(_left_over(spark, sf_dir))[1]


@query(
    rf"""WITH d AS (SELECT doc_id, {_C.format(t='text')} AS head, strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS day, strftime(DATE '2025-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS later FROM documents),
t AS (SELECT doc_id, head || ' applies from ' || day AS o, head || CASE WHEN doc_id % 3 = 2 THEN ' also' ELSE '' END || ' applies from ' || CASE WHEN doc_id % 3 = 0 THEN day ELSE later END AS n FROM d),
s AS (SELECT doc_id, o, n, list_distinct(regexp_extract_all(o, '{texts.DATE}')) AS os, list_distinct(regexp_extract_all(n, '{texts.DATE}')) AS ns FROM t),
m AS (SELECT doc_id, o, n, list_sort(list_filter(os, lambda x: NOT list_contains(ns, x))) AS removed, list_sort(list_filter(ns, lambda x: NOT list_contains(os, x))) AS added FROM s)
SELECT doc_id, CASE WHEN len(removed) + len(added) = 0 THEN 'unchanged' WHEN len(added) = 1 AND {_C.format(t="regexp_replace(o, '" + texts.DATE + "', '#', 'g')")} = {_C.format(t="regexp_replace(n, '" + texts.DATE + "', '#', 'g')")} THEN 'deferred' ELSE 'unknown' END AS verdict,
array_to_string(removed, ',') AS removed, array_to_string(added, ',') AS added FROM m"""
)
def deferral_detector(spark, sf_dir):
    """Documents under a dated clause, one year later for some, with other words for others."""
    i = F.col("doc_id")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (i % 365).cast("int")).cast("string")
    later = F.date_add(F.to_date(F.lit("2025-01-01")), (i % 365).cast("int")).cast("string")
    head = comparison_text(F.col("text"))
    old = F.concat(head, F.lit(" applies from "), day)
    new = F.concat(head, F.when(i % 3 == 2, F.lit(" also")).otherwise(F.lit("")), F.lit(" applies from "), F.when(i % 3 == 0, day).otherwise(later))
    docs = table(spark, sf_dir, "documents").select("doc_id", old.alias("old"), new.alias("new"))
    return docs.select("doc_id", texts.date_verdict("old", "new").alias("v")).select("doc_id", "v.verdict", F.array_join("v.removed", ",").alias("removed"), F.array_join("v.added", ",").alias("added"))


@query(
    rf"""WITH {fixtures.DELTA_SQL}, mod AS (SELECT act, location FROM delta WHERE change_type = 'modified'),
lo AS (SELECT act, location, i - 1 AS line, sha256({_C.format(t='s')}) AS dg FROM (SELECT act, location, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM a JOIN mod USING (act, location)) WHERE {_C.format(t='s')} <> ''),
ln AS (SELECT act, location, i - 1 AS line, sha256({_C.format(t='s')}) AS dg FROM (SELECT act, location, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b JOIN mod USING (act, location)) WHERE {_C.format(t='s')} <> '')
SELECT act, location, line, CASE WHEN lo.dg IS NULL THEN 'inserted' WHEN ln.dg IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM lo FULL JOIN ln USING (act, location, line) WHERE lo.dg IS DISTINCT FROM ln.dg"""
)
def sublocalise(spark, sf_dir):
    pair = modified_texts(spark, sf_dir)
    old, new = (pair.select("act", "location", F.col(c).alias("text")) for c in ("old", "new"))
    return texts.changed_lines(old, new, "act", "location")


@query()
def passages_excerpt(spark, sf_dir):
    e = modified_texts(spark, sf_dir).select("act", "location", texts.excerpt("old", "new").alias("e"))
    return e.select("act", "location", "e.withheld", "e.omitted", F.size("e.passages").alias("n_passages"), *[F.array_join(F.col("e.passages")[side], " / ").alias(side) for side in ("before", "after")])


@query()
def numbering_mask(spark, sf_dir):
    masked = texts.numbering_masked(comparison_text(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", digest(masked).alias("digest"), (F.char_length(masked) != F.char_length(comparison_text(F.col("text")))).alias("masked"))
