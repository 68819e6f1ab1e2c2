"""Textual twins of two trees: units paired by their words, then their children, level by level, and what found no partner.

Two nodes are twins when each is the other's best match and their ratio reaches the floor. Only nodes of one kind and, below the
roots, only children of twins are compared, never by number; ties go to the lower location. The walk down is a loop over
levels: the children of all pairs of a level are one table, and its nodes meet by rare word pairs within their parents' pair, so
no pair of nodes is formed that isn't alike, however many children a node has.

A tree is rows ``tree, location, parent, kind, pos, heading, text``; locations are unique in a tree (of repeated ones the first in
order counts) and a root's parent is null. A null text is an empty one; two empty texts are alike. A tree that isn't named
by a pair, and a pair that names an unknown tree, give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparison_text, digest, heading_key
from . import similarity
from .stages import staged
from .texts import numbering_only

#: Ratio from which two provisions are twins.
FLOOR = 0.90
#: A group of nodes that may pair: the children of a pair of nodes, of one kind.
GROUP = ("a_tree", "b_tree", "a_parent", "b_parent", "kind")


def prepared(nodes: DataFrame) -> DataFrame:
    """Nodes with comparison texts and digests, each location of a tree once."""
    text = comparison_text(F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = nodes.select("tree", F.col("location").cast("string"), F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("parent"), "kind", "pos", "heading", text.alias("text"))
    first = named.groupBy("tree", "location").agg(F.min("pos").alias("pos"))
    return named.join(first, ["tree", "location", "pos"], "left_semi").dropDuplicates(["tree", "location"]).withColumn("digest", digest(F.col("text")))


def _roots(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """The first level: the roots of both trees of each pair."""
    roots = nodes.where("parent = ''").drop("parent")
    pairs = trees.select("a_tree", "b_tree").distinct().withColumns({"a_parent": F.lit(""), "b_parent": F.lit("")})
    return _both(roots, pairs, lambda side: F.col("tree") == F.col(f"{side}_tree"))


def _below(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The children of both nodes of each pair."""
    parents = pairs.select("a_tree", "b_tree", F.col("a").alias("a_parent"), F.col("b").alias("b_parent"))
    return _both(nodes.where("parent <> ''"), parents, lambda side: (F.col("tree") == F.col(f"{side}_tree")) & (F.col("parent") == F.col(f"{side}_parent")))


def _both(nodes: DataFrame, pairs: DataFrame, on) -> DataFrame:
    sides = [nodes.join(pairs, on(side)).withColumn("side", F.lit(side)).select(*GROUP, "side", "location", "pos", "heading", "text", "digest") for side in "ab"]
    level = sides[0].unionByName(sides[1])
    # a number for each node of a level, even on the first side and odd on the second
    return staged(level.withColumn("row", 2 * F.monotonically_increasing_id() + (F.col("side") == "b").cast("int")))


def scored(level: DataFrame, floor: float) -> DataFrame:
    """(GROUP, a, b, ratio): the pairs of a level that reach the floor, of equal texts only those that can be a best match."""

    def side(name: str) -> DataFrame:
        return level.where(F.col("side") == name).select(*GROUP, F.col("row").alias(f"{name}_row"), F.col("digest").alias(f"{name}_digest"), F.col("location").alias(name))

    near = similarity.candidates(level, "row", "side", "text", floor, GROUP)
    is_a = F.col("left") % 2 == 0
    near = near.select(F.when(is_a, F.col("left")).otherwise(F.col("right")).alias("a_row"), F.when(is_a, F.col("right")).otherwise(F.col("left")).alias("b_row"))
    # groups and digests first: equal texts need no ratio, so theirs don't move
    near = staged(near.join(side("a"), "a_row").join(side("b"), ["b_row", *GROUP]).where("a_digest <> b_digest").select(*GROUP, "a_row", "b_row", "a", "b"))
    ratios = similarity.paired_ratios(near.select(F.col("a_row").alias("left"), F.col("b_row").alias("right")), level, "row", "text", floor)
    close = near.join(ratios.toDF("a_row", "b_row", "ratio"), ["a_row", "b_row"]).select(*GROUP, "a", "b", "ratio")
    # of equal texts the best match is the lowest location, so each meets that one of the other side only
    lowest = [F.min(F.when(F.col("side") == s, F.col("location"))).alias(f"{s}_low") for s in "ab"]
    shared = level.groupBy(*GROUP, "digest").agg(*lowest).where("a_low IS NOT NULL AND b_low IS NOT NULL")
    each = level.select(*GROUP, "digest", "side", "location").join(shared, [*GROUP, "digest"])
    is_a = F.col("side") == "a"
    equal = each.select(*GROUP, F.when(is_a, F.col("location")).otherwise(F.col("a_low")).alias("a"), F.when(is_a, F.col("b_low")).otherwise(F.col("location")).alias("b"), F.lit(1.0).alias("ratio"))
    return close.unionByName(equal.distinct())


def best(pairs: DataFrame, side: str, other: str) -> DataFrame:
    """The best match of each node of a side: highest ratio, then lowest location."""
    top = F.min(F.struct((-F.col("ratio")).alias("r"), F.col(other).alias("o"))).alias("top")
    return pairs.groupBy(*GROUP, side).agg(top).select(*GROUP, side, F.col("top.o").alias(other), (-F.col("top.r")).alias("ratio"))


def aligned(nodes: DataFrame, trees: DataFrame, floor: float = FLOOR, deepest: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired) of each pair of trees (a_tree, b_tree).

    ``pairs``: (GROUP, depth, a, b, ratio), roots at depth 0. ``unpaired``: (GROUP, depth, side, location, best, ratio): nodes
    without a partner whose parents are twins and both have children of some kind, with the best match at the floor that
    preferred another, if any. Ratios are unrounded. A tree deeper than ``deepest`` raises an error.
    """
    nodes = staged(prepared(nodes))
    level, pairs, unpaired = _roots(nodes, trees), [], []
    for depth in range(deepest + 1):
        held = staged(scored(level, floor))
        best_a, best_b = best(held, "a", "b"), best(held, "b", "a")
        mutual = staged(best_a.join(best_b.drop("ratio"), [*GROUP, "a", "b"]).withColumn("depth", F.lit(depth)))
        pairs.append(mutual)
        found = best_a.select(*GROUP, F.lit("a").alias("side"), F.col("a").alias("location"), F.col("b").alias("best"), "ratio")
        found = found.unionByName(best_b.select(*GROUP, F.lit("b").alias("side"), F.col("b").alias("location"), F.col("a").alias("best"), "ratio"))
        paired = mutual.select(*GROUP, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("location")), F.struct(F.lit("b").alias("side"), F.col("b").alias("location")))).alias("n")).select(*GROUP, "n.*")
        alone = level.select(*GROUP, "side", "location").join(paired, [*GROUP, "side", "location"], "left_anti")
        unpaired.append(alone.join(found, [*GROUP, "side", "location"], "left").withColumn("depth", F.lit(depth)))
        children = _below(nodes, mutual)
        both = children.groupBy(*GROUP[:4]).agg(F.count_distinct("side").alias("n")).where("n = 2").drop("n")
        level = children.join(both, list(GROUP[:4]), "left_semi")
        if level.isEmpty():
            break
    else:
        raise ValueError(f"a tree is deeper than {deepest} levels")
    return reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, unpaired)


def described(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs as a twin map shows them: the ratio to three places, whether texts are identical or differ in numbering
    only, and whether the headings are equal (an empty one equals none)."""
    sides = prepared(nodes)
    for s in "ab":
        side = sides.select(F.col("tree").alias(f"{s}_tree"), F.col("location").alias(s), F.col("pos").alias(f"{s}_pos"), F.col("text").alias(f"{s}_text"), heading_key(F.coalesce("heading", F.lit(""))).alias(f"{s}_head"))
        pairs = pairs.join(side, [f"{s}_tree", s])
    same = F.col("a_text") == F.col("b_text")
    alike = (F.col("a_head") != "") & (F.col("a_head") == F.col("b_head"))
    told = {"ratio": F.bround("ratio", 3), "identical": same, "numbering_only": numbering_only(F.col("a_text"), F.col("b_text")), "headings_equal": alike}
    return pairs.withColumns(told).drop("a_text", "b_text", "a_head", "b_head")
