"""Ordered per-key work that survives a key holding a large share of all rows.

A plain window sends each key to one task. Here a key with more than ``limit``
rows is cut into blocks of that many rows along its order, each block is windowed
alone, and a small table with one row per block carries the result across block
edges. Borders are the order's own values, found by numbering the hot keys' rows, so
bursts and outliers make no block larger; only rows alike in the whole order stay together.

``cut_keys`` measures the row counts once; without a hot key the plain window
runs. One cut serves every later step over the same rows or a part of them.
With a hot key each step writes its windowed rows once, because both the block
edges and the result read them.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.operators.numbering import number_rows
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

# Rows of one key that a single task may window. 2M narrow rows sort in memory.
KEY_ROW_LIMIT = 2_000_000

# Keys are counted by so many buckets first; only those of buckets over the limit are counted one by one.
COUNT_BUCKETS = 1 << 16

BLOCK = "_block"
HOT = "_hot"


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``k`` and ``prefix + k``."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(prefix + k))
    return match


@dataclass(frozen=True)
class Cut:
    """How the hot keys split. ``hot`` is None when no key exceeds the limit."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: DataFrame | None

    def narrowed(self, keys: Sequence[str]) -> "Cut":
        """The same finding for keys that divide these, when nothing was cut."""
        if self.hot is not None:
            raise ValueError("measure the narrower keys when there are hot ones")
        return Cut(tuple(keys), self.order, None)

    def blocks(self, df: DataFrame) -> DataFrame:
        if self.hot is None:
            return df.withColumn(BLOCK, F.lit(0)).withColumn(HOT, F.lit(False))
        at = F.struct(*self.order)
        passed = F.size(F.filter("_borders", lambda b: b <= at))
        return (
            df.join(self.hot, same_keys(self.keys, "_h_"), "left")
            .withColumn(HOT, F.col("_borders").isNotNull())
            .withColumn(BLOCK, F.when(F.col(HOT), passed).otherwise(0))
            .drop("_borders", *[f"_h_{k}" for k in self.keys])
        )

    def window(self, order: Sequence[str]):
        # Without hot keys all windows of one cut share one partitioning and sort.
        return Window.partitionBy(*self.keys, *([] if self.hot is None else [BLOCK])).orderBy(*order)

    def edges(self, rows: DataFrame, *aggregates: Column) -> DataFrame:
        """One row per block of the hot keys."""
        return rows.where(F.col(HOT)).groupBy(*self.keys, BLOCK).agg(*aggregates)

    def earlier(self):
        """The blocks of the same key before this one."""
        w = Window.partitionBy(*self.keys).orderBy(BLOCK)
        return w.rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """Attach each block's ``_carry`` to its rows."""
        on = (*self.keys, BLOCK)
        side = edges.select(*[F.col(k).alias(f"_e_{k}") for k in on], "_carry")
        return rows.join(side, same_keys(on, "_e_"), "left").drop(*[f"_e_{k}" for k in on])


def cut_keys(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], limit: int = KEY_ROW_LIMIT
) -> Cut:
    """Find the keys with more than ``limit`` rows (a map-side count of buckets of keys, then of the keys in large
    buckets) and their borders.

    ``order`` names the columns that order a key's rows, all of them, so that equal leading values can be cut.
    """
    keys, order = tuple(keys), (order,) if isinstance(order, str) else tuple(order)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS))
    large = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_bucket")
    large = staged(large, "large-buckets")
    if large.isEmpty():
        return Cut(keys, order, None)
    suspects = df.select(*keys).join(F.broadcast(large), bucket == F.col("_bucket"), "left_semi")
    sizes = suspects.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    sizes = staged(sizes.select(*[F.col(k).alias(f"_h_{k}") for k in keys]), "hot-sizes")
    if sizes.isEmpty():
        return Cut(keys, order, None)
    # Only the hot keys' order columns are sorted, in even ranges whatever the key.
    hot = df.select(*keys, F.struct(*order).alias("_at")).join(broadcast_if_small(sizes), same_keys(keys, "_h_"), "left_semi")
    numbered = number_rows(hot, list(keys), ["_at"], "_row", start=0)
    firsts = numbered.where((F.col("_row") > 0) & (F.col("_row") % limit == 0))
    # One value per block of a key.
    side = firsts.groupBy(*[F.col(k).alias(f"_h_{k}") for k in keys]).agg(
        F.sort_array(F.collect_set("_at")).alias("_borders")
    )
    return Cut(keys, order, broadcast_if_small(staged(side, "hot-keys")))


def previous_row(df: DataFrame, cut: Cut, order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: a struct of ``columns`` from the row before, null on a key's first row."""
    row = F.struct(*columns)
    out = cut.blocks(df).withColumn(name, F.lag(row).over(cut.window(order)))
    if cut.hot is not None:
        out = staged(out, "blocks")
        last = cut.edges(out, F.max_by(row, F.struct(*order)).alias("_last"))
        by_block = Window.partitionBy(*cut.keys).orderBy(BLOCK)
        out = cut.carry(out, last.withColumn("_carry", F.lag("_last").over(by_block)))
        out = out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    return out.drop(BLOCK, HOT)


def running_sum(df: DataFrame, cut: Cut, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` up to and including the row."""
    rows = cut.blocks(df.withColumn("_amount", amount.cast("bigint")))
    window = cut.window(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, F.sum("_amount").over(window))
    if cut.hot is not None:
        out = staged(out, "blocks")
        totals = cut.edges(out, F.sum("_amount").alias("_part"))
        out = cut.carry(out, totals.withColumn("_carry", F.sum("_part").over(cut.earlier())))
        out = out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")
    return out.drop(BLOCK, HOT, "_amount")


def scan(df: DataFrame, cut: Cut, order: Sequence[str], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add several running folds in one pass. ``folds`` maps a new column to a kind and a value.

    Kinds are ``last`` (latest non-null), ``sum``, ``min`` and ``max``, over the rows up to and including the row; nulls
    do not count. A minimum that starts anew is the ``max`` of a struct of the run's number and the negated value.
    """
    over = cut.window(order).rowsBetween(Window.unboundedPreceding, 0)
    folded = {
        "last": lambda c: F.last(c, ignorenulls=True).over(over), "sum": lambda c: F.sum(c).over(over),
        "min": lambda c: F.min(c).over(over), "max": lambda c: F.max(c).over(over),
    }
    if cut.hot is None:
        return df.withColumns({n: folded[kind](value) for n, (kind, value) in folds.items()})
    values = {f"_v_{n}": value for n, (_, value) in folds.items()}
    out = cut.blocks(df).withColumns(values).withColumns({n: folded[kind](F.col(f"_v_{n}")) for n, (kind, _) in folds.items()})
    out = staged(out, "blocks")
    at = F.struct(*order)

    def edge(kind: str, value: Column) -> Column:
        if kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), at))
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)

    def carried(kind: str, value: Column) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(cut.earlier())
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(cut.earlier())

    def joined(kind: str, before: Column, here: Column) -> Column:
        if kind == "sum":
            return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
        return {"last": lambda: F.coalesce(here, before), "min": lambda: F.least(before, here), "max": lambda: F.greatest(before, here)}[kind]()

    edges = cut.edges(out, *[edge(kind, F.col(f"_v_{n}")).alias(f"_e_{n}") for n, (kind, _) in folds.items()])
    edges = edges.withColumn("_carry", F.struct(*[carried(kind, F.col(f"_e_{n}")).alias(n) for n, (kind, _) in folds.items()]))
    out = cut.carry(out.drop(*values), edges)
    out = out.withColumns({n: joined(kind, F.col(f"_carry.{n}"), F.col(n)) for n, (kind, _) in folds.items()})
    return out.drop("_carry", BLOCK, HOT)


def row_number(df: DataFrame, cut: Cut, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 … within the key."""
    return running_sum(df, cut, order, F.lit(1), name)


def fill_forward(df: DataFrame, cut: Cut, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """For each ``new: source`` pair, the latest non-null source value up to and including the row."""
    rows = cut.blocks(df)
    window = cut.window(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns(
        {new: F.last(src, ignorenulls=True).over(window) for new, src in columns.items()}
    )
    if cut.hot is not None:
        out = staged(out, "blocks")
        at = F.struct(*order)
        latest = cut.edges(
            out,
            *[
                F.max_by(F.col(src), F.when(F.col(src).isNotNull(), at)).alias(f"_l_{new}")
                for new, src in columns.items()
            ],
        )
        carried = F.struct(
            *[F.last(f"_l_{n}", ignorenulls=True).over(cut.earlier()).alias(n) for n in columns]
        )
        out = cut.carry(out, latest.withColumn("_carry", carried))
        out = out.withColumns({n: F.coalesce(n, f"_carry.{n}") for n in columns}).drop("_carry")
    return out.drop(BLOCK, HOT)
