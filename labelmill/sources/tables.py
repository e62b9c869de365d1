"""Typed loading and writing of the declared tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.schemas import table_type


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A declared table; columns outside the schema are not read."""
    shape = table_type(name)
    # Partition columns come last in a scan; the select restores the declared order.
    return spark.read.schema(shape).parquet(path).select(*shape.names)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project to the declared columns and types; a column missing from ``df`` becomes null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_type(name).fields
        ]
    )


def write_table(
    df: DataFrame, name: str, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a table in its declared shape, by default refusing to overwrite."""
    out = conform(df, name).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
