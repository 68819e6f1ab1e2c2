"""Queries on the twins of two trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import twins
from . import fixtures

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _trees(spark, sf_dir):
    """Both versions of each act as trees: documents, their lines, the sentences of a line; and the pairs of versions."""

    def nodes(version, name: str):
        units = version.select(F.concat("act", F.lit(f"/{name}")).alias("tree"), F.concat(F.lit("AR "), F.col("location").cast("string")).alias("location"), "text")
        lines = units.select("tree", F.col("location").alias("parent"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("trim(text) <> ''")
        lines = lines.select("tree", F.concat_ws(" PA ", "parent", F.col("pos").cast("string")).alias("location"), "parent", "pos", "text")
        parts = lines.select("tree", F.col("location").alias("parent"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "text"))
        parts = parts.select("tree", F.concat_ws(" ALN ", "parent", F.col("pos").cast("string")).alias("location"), "parent", "pos", "text")
        top = units.select("tree", "location", F.lit(None).cast("string").alias("parent"), F.lit("AR").alias("kind"), F.lit(0).alias("pos"), F.substring_index("text", "\n", 1).alias("heading"), "text")
        below = [rows.select("tree", "location", "parent", F.lit(kind).alias("kind"), "pos", F.lit(None).cast("string").alias("heading"), "text") for rows, kind in ((lines, "PA"), (parts, "ALN"))]
        return top.unionByName(below[0]).unionByName(below[1])

    before, after = fixtures.before(spark, sf_dir), fixtures.after(spark, sf_dir)
    pairs = before.select("act").distinct().select(F.concat("act", F.lit("/1")).alias("a_tree"), F.concat("act", F.lit("/2")).alias("b_tree"))
    return nodes(before, "1").unionByName(nodes(after, "2")), pairs


@query()
def twin_tree_pairs(spark, sf_dir):
    """Units of both versions that are twins, and below them their lines and sentences."""
    nodes, trees = _trees(spark, sf_dir)
    pairs, _ = twins.aligned(nodes, trees)
    return twins.described(pairs, nodes).select("a_tree", "b_tree", "depth", "a", "b", "ratio", "identical", "numbering_only", "headings_equal")


@query()
def twin_tree_unpaired(spark, sf_dir):
    """What found no twin beside units or below twins, with its best match that preferred another."""
    nodes, trees = _trees(spark, sf_dir)
    _, unpaired = twins.aligned(nodes, trees)
    return unpaired.select("a_tree", "b_tree", "depth", "side", "location", "best", F.bround("ratio", 3).alias("ratio"))
