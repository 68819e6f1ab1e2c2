"""Ranks over a whole table or a hot group without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import staged


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 by ``order``, which should tell rows apart.

    A range shuffle deals the rows, once: its borders come of a sample, and another run may draw others, so the rows are
    written with their range's number before they are counted. Each range counts on its own, and the counts of the ranges
    before (one row each) are added.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return laid.withColumn("_r", within).join(bases, "_part").withColumn(name, F.col("_b") + F.col("_r")).drop("_part", "_r", "_b")
