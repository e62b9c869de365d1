"""Contiguous numbers over any sort order, without a single-task window.

Rows are range-partitioned on the sort columns and written once. In the written
table every row knows its partition and its place in it, so a number is that
place plus the rows of earlier partitions. The per-partition counts are one
row per (partition, group) and the ranges are even whatever the group sizes.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.staging import staged


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str, start: int = 1
) -> DataFrame:
    """Add ``name``: ``start``, ``start + 1`` … within ``group`` (empty for one run over all rows)."""
    group = list(group)
    laid = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    table = staged(laid, "numbered")
    runs = table.groupBy(*group, "_part").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    )
    # One row per partition and group: with no group this is one row per partition.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_part").alias("_g_part"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + start - F.col("_first")).alias("_shift"),
    )
    match = F.col("_part") == F.col("_g_part")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        table.join(runs, match)
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_shift", "_g_part", *[f"_g_{g}" for g in group])
    )
