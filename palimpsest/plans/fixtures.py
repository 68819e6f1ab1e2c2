"""How the driver tables stand in for versions, claims, feeds and watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every document id is re-keyed by where the second version renumbers it.
SHIFT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version: every document is a unit of the act named by its source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("act"), F.col("doc_id").alias("location"), F.col("doc_id").alias("pos"), "text")


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version: the whole first one under a fixed edit script that deletes, amends, re-keys and respaces units."""
    i = F.col("location")
    text = F.when(i % 11 == 0, F.concat("text", F.lit(" amended"))).when(i % 7 == 0, F.concat("text", F.lit(" \n"))).otherwise(F.col("text"))
    moved = F.when(i % 13 == 0, i + SHIFT).otherwise(i)
    return before(spark, sf_dir).where(i % 17 != 0).select("act", moved.alias("location"), "pos", text.alias("text"))


#: DuckDB: both versions as units with digests, and their full outer match.
DELTA_SQL = r"""
a AS (SELECT source AS act, doc_id AS location, doc_id AS pos, text FROM documents),
b AS (SELECT act, CASE WHEN location % 13 = 0 THEN location + 1000000 ELSE location END AS location, pos,
             CASE WHEN location % 11 = 0 THEN text || ' amended' WHEN location % 7 = 0 THEN text || chr(32) || chr(10) ELSE text END AS text
      FROM a WHERE location % 17 <> 0),
o AS (SELECT act, location, pos, sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))) AS digest, md5(text) AS verbatim FROM a),
n AS (SELECT act, location, pos, sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))) AS digest, md5(text) AS verbatim FROM b),
delta AS (
  SELECT coalesce(o.act, n.act) AS act, coalesce(o.location, n.location) AS location, o.pos AS old_pos, n.pos AS new_pos,
         o.digest AS old_digest, n.digest AS new_digest, o.verbatim AS old_verbatim, n.verbatim AS new_verbatim,
         CASE WHEN o.pos IS NULL THEN 'inserted' WHEN n.pos IS NULL THEN 'deleted'
              WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'unchanged' ELSE 'modified' END AS change_type
  FROM o FULL JOIN n ON o.act = n.act AND o.location = n.location),
pairs AS (
  SELECT g.act, g.location AS old_location, c.location AS new_location, g.old_pos
  FROM (SELECT *, row_number() OVER (PARTITION BY act, old_digest ORDER BY old_pos) AS k FROM delta WHERE change_type = 'deleted') g
  JOIN (SELECT *, row_number() OVER (PARTITION BY act, new_digest ORDER BY new_pos) AS k FROM delta WHERE change_type = 'inserted') c
    ON g.act = c.act AND g.old_digest = c.new_digest AND g.k = c.k)
"""

#: DuckDB: the delta with each renumbered pair as one row.
RENUMBERED_SQL = (
    DELTA_SQL
    + r""",
delta2 AS (
  SELECT d.act, d.location, coalesce(d.old_pos, p.old_pos) AS old_pos, d.new_pos, p.old_location,
         CASE WHEN p.old_location IS NOT NULL THEN 'renumbered' ELSE d.change_type END AS change_type
  FROM delta d LEFT JOIN pairs p ON d.act = p.act AND d.location = p.new_location
  WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.act = d.act AND q.old_location = d.location))
"""
)

#: DuckDB: the delta's units beside what labels claim of them.
SIGNALS_SQL = (
    RENUMBERED_SQL
    + r""",
diff AS (SELECT act, CASE WHEN location >= 1000000 THEN location - 1000000 ELSE location END AS unit,
                CASE WHEN change_type = 'renumbered' THEN 'modified' ELSE change_type END AS diff_kind
         FROM delta2 WHERE change_type <> 'unchanged'),
labelled AS (SELECT d.source AS act, l.doc_id AS unit,
                    max(CASE WHEN l.toxic = 1 THEN 'modified' WHEN l.quality = 0 THEN 'deleted' END) AS claimed_kind
             FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2),
claims AS (SELECT * FROM labelled WHERE claimed_kind IS NOT NULL),
available AS (SELECT DISTINCT act FROM labelled),
merged AS (
  SELECT m.*, CASE WHEN diff_kind IS NOT NULL THEN 'observed' ELSE 'absent' END AS diff_status,
         CASE WHEN claimed_kind IS NOT NULL THEN 'observed' WHEN v.act IS NOT NULL THEN 'absent' ELSE 'unavailable' END AS claim_status,
         diff_kind IS NULL AS textless
  FROM (SELECT coalesce(d.act, c.act) AS act, coalesce(d.unit, c.unit) AS unit, d.diff_kind, c.claimed_kind
        FROM diff d FULL JOIN claims c ON d.act = c.act AND d.unit = c.unit) m LEFT JOIN available v ON m.act = v.act),
judged AS (
  SELECT *, (diff_status = 'observed' AND claim_status = 'absent') OR (diff_status = 'absent' AND claim_status = 'observed') AS presence,
         coalesce(diff_kind <> claimed_kind, false) AS kinds FROM merged),
disputed AS (
  SELECT *, presence OR kinds AS disputed,
         CASE WHEN presence AND textless THEN 'textless' WHEN presence THEN 'silent' WHEN kinds THEN 'kind' END AS reason FROM judged),
cases AS (
  SELECT act, count(*) FILTER (diff_status = 'observed') AS n_diff, count(*) FILTER (claim_status = 'observed') AS n_claimed,
         count(*) FILTER (diff_status = 'observed' AND claim_status = 'observed') AS n_shared,
         count(*) FILTER (diff_status = 'observed' AND claim_status = 'observed' AND diff_kind <> claimed_kind) AS n_kind_mismatch
  FROM merged GROUP BY act),
scored AS (
  SELECT *, CASE WHEN n_diff = 0 THEN 1.0::DOUBLE ELSE n_shared / n_diff::DOUBLE END AS precision,
         CASE WHEN n_claimed = 0 THEN 1.0::DOUBLE ELSE n_shared / n_claimed::DOUBLE END AS recall FROM cases),
agreed AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM scored),
pool AS (
  SELECT sum(n_diff)::BIGINT AS n_diff, sum(n_claimed)::BIGINT AS n_claimed, sum(n_shared)::BIGINT AS n_shared, avg(f1) AS macro_f1 FROM agreed),
pool2 AS (SELECT *, n_shared / n_diff::DOUBLE AS micro_precision, n_shared / n_claimed::DOUBLE AS micro_recall FROM pool),
pool3 AS (SELECT *, CASE WHEN micro_precision + micro_recall = 0 THEN 0.0::DOUBLE ELSE 2 * micro_precision * micro_recall / (micro_precision + micro_recall) END AS micro_f1 FROM pool2)
"""
)
