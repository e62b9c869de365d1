"""Pages and ordered vocabularies."""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import shared_dir, staged

# Pages that end within this many rows come from a top-k; deeper ones from an index of the order.
TOP_K_ROWS = 100_000


def _order(sort: Sequence[tuple[str, str]]) -> list[Column]:
    keys = []
    for column, direction in sort:
        if direction not in ("asc", "desc"):
            raise ValueError("sort direction must be asc or desc")
        col = F.col(column)
        keys.append(col.asc_nulls_first() if direction == "asc" else col.desc_nulls_last())
    return keys


class PageIndex:
    """The order of a table's rows, written once for any number of pages.

    Holds the sort columns and the key of every row in even ranges, a folder each, and how many rows lie before each
    range. A page opens the folders of its own rows, one as a rule, and then reads the table
    between the first and last of their sort values; neither sorts nor writes whole rows.
    """

    def __init__(self, df: DataFrame, key: str, sort: Sequence[tuple[str, str]], ranges: int | None = None):
        self.df, self.key, self.first = df, key, sort[0][0]
        order = [*_order(sort), F.col(key)]
        names = list(dict.fromkeys([*[c for c, _ in sort], key]))
        narrow = df.select(*names)
        laid = narrow.repartitionByRange(ranges, *order) if ranges else narrow.repartitionByRange(*order)
        laid = laid.sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        # The low 33 bits number a task's rows in order.
        laid = laid.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        self.path = f"{shared_dir(df.sparkSession)}/pages-{uuid.uuid4().hex}"
        self.schema = laid.schema
        laid.write.partitionBy("_range").parquet(self.path)
        sizes = self._rows().groupBy("_range").agg(F.count("*").alias("_n"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        # One row a range.
        self.sizes = staged(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "page-ranges")

    def _rows(self) -> DataFrame:
        return self.df.sparkSession.read.schema(self.schema).parquet(self.path)

    def places(self, page: int, limit: int) -> DataFrame:
        """Sort columns, key and ``_row`` (from 0) of the rows of a page."""
        skip = (page - 1) * limit
        inside = (F.col("_before") < skip + limit) & (F.col("_before") + F.col("_n") > skip)
        shifts = {r["_range"]: r["_before"] for r in self.sizes.where(inside).collect()}
        row = F.col("_place") + F.coalesce(*[F.when(F.col("_range") == r, F.lit(b)) for r, b in shifts.items()], F.lit(0))
        rows = self._rows().where(F.col("_range").isin(list(shifts))) if shifts else self._rows().where(F.lit(False))
        return rows.withColumn("_row", row).where(F.col("_row").between(skip, skip + limit - 1)).drop("_range", "_place")

    def page(self, page: int, limit: int) -> DataFrame:
        places = staged(self.places(page, limit), "page")
        edges = places.agg(F.min(self.first).alias("low"), F.max(self.first).alias("high"), F.count_if(F.col(self.first).isNull()).alias("nulls")).first()
        inside = F.col(self.first).between(F.lit(edges["low"]), F.lit(edges["high"]))
        found = self.df.where(inside | F.col(self.first).isNull() if edges["nulls"] else inside)
        keys = places.select(F.col(self.key).alias("_key"), "_row")
        return found.join(broadcast_if_small(keys), F.col(self.key) == F.col("_key")).orderBy("_row").drop("_key", "_row")


def page(
    df: DataFrame, key: str, page: int = 1, limit: int = 50,
    sort: Sequence[tuple[str, str]] = (("created_at", "desc"),), index: PageIndex | None = None,
) -> DataFrame:
    """Rows of one page, in order, ties broken by ``key``, which is unique.

    A page within the first rows is a top-k; a deeper one is found by ``index``, made for this call if not given.
    """
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    skip = (page - 1) * limit
    if index is None and skip + limit <= TOP_K_ROWS:
        return df.orderBy(*_order(sort), F.col(key)).offset(skip).limit(limit)
    return (index or PageIndex(df, key, sort)).page(page, limit)


def page_count(df: DataFrame, limit: int = 50) -> DataFrame:
    """``total`` and ``total_pages``."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("bigint")
    )


def order_terms(terms: Column, last_value: str, last_label: str) -> Column:
    """Terms by ``order`` (stable), with the "no label" term added at 999 when missing."""
    placed = F.transform(
        terms, lambda t, i: F.struct(t["order"].alias("order"), i.alias("i"), t.alias("t"))
    )
    ordered = F.transform(F.array_sort(placed), lambda p: p["t"])
    missing = ~F.exists(terms, lambda t: t["value"] == last_value)
    extra = F.struct(
        F.lit(last_value).alias("value"), F.lit(last_label).alias("label"),
        F.lit(999.0).alias("order"),
    )
    return F.when(missing, F.concat(ordered, F.array(extra))).otherwise(ordered)
