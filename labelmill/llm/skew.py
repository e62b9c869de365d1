"""Joins whose left side may have a third of its rows on one key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot with more than this share of all rows, so there are at most HOT_KEYS of them.
HOT_KEYS = 2000
HOT_ROWS = 2000


def spread_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: Column, how: str = "inner"
) -> DataFrame:
    """Join on one key; a hot key of ``left`` is dealt by ``spread`` to as many parts as its rows need, and
    its ``right`` rows are repeated for each.

    ``left`` is read three times (number of rows, counts, join), so stage it if it is costly.
    """
    counts = left.groupBy(F.col(left_key).alias("_hot")).agg(F.count("*").alias("_n"))
    total = left.agg(F.greatest(F.count("*") / HOT_KEYS, F.lit(HOT_ROWS)).alias("_most"))
    hot = counts.where(F.col("_hot").isNotNull()).join(F.broadcast(total), F.col("_n") > F.col("_most"))
    hot = F.broadcast(hot.select("_hot", F.ceil(F.col("_n") / F.col("_most")).cast("int").alias("_parts")))
    dealt = left.join(hot, F.col(left_key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).otherwise(0)
    )
    repeated = right.join(hot.toDF("_hot2", "_parts2"), F.col(right_key) == F.col("_hot2"), "left")
    each = F.sequence(F.lit(0), F.coalesce(F.col("_parts2"), F.lit(1)) - 1)
    repeated = repeated.withColumn("_part", F.explode(each)).drop("_hot2", "_parts2")
    same = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_part"))
    return dealt.drop("_hot", "_parts").join(repeated, same, how).drop("_salt", "_part")
