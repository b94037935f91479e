"""Places in an order without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[Column | str]) -> DataFrame:
    """The rows with their ``place`` from 0 in their group, and the group's size ``n``.

    ``block`` is a coarse part of the order, not null: lower blocks come first. Rows are sorted within a block, and only blocks are summed
    up over a group, so a group that holds a third of all rows is sorted in as many tasks as it has blocks.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*keys)).alias("n"))
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    joined = rows.withColumn("_in", within).join(counts, [*keys, "_block"])
    return joined.withColumn("place", (F.col("_before") + F.col("_in")).cast("int")).drop("_block", "_before", "_in")
