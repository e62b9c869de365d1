"""Connected components of a link table, by alternating large-star and small-star steps.

A large star links a node's larger neighbours to its smallest one, a small star its smaller ones;
both keep the components, and their alternation ends with every node linked to the smallest of its
component. Each round is a few shuffles over at most as many links as before, written to the
shared folder; nothing but a count and a checksum reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.skew import spread_join
from labelmill.staging import staged


def _mark(links: DataFrame) -> tuple:
    both = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(both), F.sum(F.pmod(both, F.lit(1_000_003)))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has a and b of one comparable type. Returns node and root (the smallest node of its
    component) of every linked node; a null or self link is left out, a repeated one counts once."""
    current = staged(
        links.where((F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    mark = _mark(current)
    while True:
        both = staged(current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("m"))
        large = staged(
            spread_join(both, low, "a", "n", F.col("b"))
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(),
            "links",
        )
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        star = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        following = staged(
            spread_join(large, least, "a", "n", F.col("b")).select(star.alias("a"), F.col("m").alias("b")).distinct(),
            "links",
        )
        previous, mark = mark, _mark(following)
        current = following
        if mark == previous:
            roots = current.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
