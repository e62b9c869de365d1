"""A table in files whose parts are replaced one by one.

Rows lie in one folder for each value of a column or, when it has very many values, in a bounded number of folders
that hold several values each. A change finds the folders that hold its keys, writes those folders anew beside the
old ones, and swaps in a manifest that names them:

    rows/write=3/slot=9f86…/part-*.parquet
    manifests/000000000003.json

Readers find the table as it was before or after a change, and folders of a few earlier states stay for readers
that have begun. Two writers at once cannot both win: the second one raises.
"""

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill import storage
from labelmill.operators import updates
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

SLOT = "slot"
# Digits of a value's digest that name a folder of its own.
WHOLE = 32


class PartitionedTable:
    """``column`` splits the rows; its values are not bounded in length, so folders have digests of them.

    A column of more than ``most`` values shares folders: values whose digests begin alike lie in one.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, schema: StructType, keep: int = 3, most: int = 1000):
        self.spark, self.path, self.column, self.schema, self.most = spark, path, column, schema, most
        self.manifests = storage.Manifests(spark, f"{path}/manifests", keep)

    def _slot(self, digits: int | None = None) -> Column:
        value = F.col(self.column).cast("string")
        digits = self._state()["digits"] if digits is None else digits
        return F.when(value.isNull(), "null").otherwise(F.substring(F.sha2(value, 256), 1, digits))

    def _state(self) -> dict:
        return {"number": -1, "slots": {}, "digits": WHOLE} | (self.manifests.newest() or {})

    def _digits(self, rows: DataFrame) -> int:
        """How many digits of the digests name the folders of ``rows``."""
        if rows.select(self.column).distinct().limit(self.most + 1).count() <= self.most:
            return WHOLE
        digits = 1
        while 16 ** (digits + 1) <= self.most:
            digits += 1
        return digits

    def folders(self, slots: Sequence[str] | None = None) -> list[str]:
        held = self._state()["slots"]
        chosen = held.keys() if slots is None else set(slots)
        return [f"{self.path}/rows/write={n}/{SLOT}={s}" for s, n in held.items() if s in chosen]

    def read(self, slots: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of some folders, as they are now."""
        folders = self.folders(slots)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame) -> list[str]:
        """The whole table anew; returns the slots written."""
        return self._swap(rows, None)

    def _swap(self, rows: DataFrame, slots: Sequence[str] | None) -> list[str]:
        """Replace the folders of ``slots`` (all if None) by ``rows``."""
        old = self._state()
        number = old["number"] + 1
        target = f"{self.path}/rows/write={number}"
        digits = self._digits(rows) if slots is None else old["digits"]
        laid = rows.select(*self.schema.names).withColumn(SLOT, self._slot(digits))
        # Rows of a folder come together, so that a task does not write a file for each of them; large ones are split.
        laid.hint("rebalance", SLOT).write.partitionBy(SLOT).mode("overwrite").parquet(target)
        written = [n.removeprefix(f"{SLOT}=") for n in storage.names(self.spark, target) if n.startswith(f"{SLOT}=")]
        replaced = set(old["slots"] if slots is None else slots)
        kept = {s: n for s, n in old["slots"].items() if s not in replaced}
        self.manifests.put({"number": number, "slots": kept | {s: number for s in written}, "digits": digits})
        gone = self.manifests.drop_old()
        named = {(n, s) for m in self.manifests.kept() for s, n in m["slots"].items()}
        for n, s in {(n, s) for m in gone for s, n in m["slots"].items()} - named:
            storage.remove(self.spark, f"{self.path}/rows/write={n}/{SLOT}={s}")
        return written

    def slots_of(self, keys: DataFrame, key: str) -> list[str]:
        """The folders that hold rows of these keys, found from the key and split columns alone. A name for each folder,
        of which there are ``most`` and one for nulls at most, reaches the driver, as it does in the manifest."""
        rows = self.read().select(key, self._slot().alias(SLOT))
        return sorted(r[0] for r in rows.join(keys.select(key).distinct(), key, "left_semi").select(SLOT).distinct().collect())

    def change(self, keys: DataFrame, key: str, how: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Rewrite the folders that hold rows of ``keys`` by ``how``, which must leave the split column alone."""
        slots = self.slots_of(keys, key)
        if slots:
            self._swap(how(self.read(slots)), slots)
        return slots

    def upsert(
        self, patches: DataFrame, key: str, columns: Sequence[str], at: datetime, order: str | None = None
    ) -> list[str]:
        """``updates.upsert`` in place; returns the folders rewritten."""
        if self.column in columns:
            raise ValueError(f"the table is split by {self.column}")
        patches = staged(patches, "patches")
        return self.change(patches, key, lambda rows: updates.upsert(rows, patches, key, columns, at, order))

    def delete(self, keys: DataFrame, key: str) -> list[str]:
        """Drop the rows of ``keys``; returns the folders rewritten."""
        keys = staged(keys.select(key).distinct(), "keys")
        return self.change(keys, key, lambda rows: rows.join(broadcast_if_small(keys), key, "left_anti"))


def delete_cascade(
    tables: dict[str, PartitionedTable], doomed: DataFrame, key: str,
    children: Sequence[tuple[str, str, str]], keys: dict[str, str],
) -> dict[str, list[str]]:
    """``updates.delete_cascade`` in place: each table loses its rows by rewriting the folders that hold some.

    Returns the folders rewritten of each table. Tables change from the bottom up, so that a run that is broken off
    and repeated finds all that it still has to drop.
    """
    found = {"": staged(doomed.select(F.col(key).alias("_gone")).distinct(), "doomed")}
    parents = {parent for _, _, parent in children}
    for table, column, parent in children:
        if table in parents:
            gone = found[parent].withColumnRenamed("_gone", column)
            rows = tables[table].read().join(broadcast_if_small(gone), column, "left_semi")
            found[table] = staged(rows.select(F.col(keys[table]).alias("_gone")).distinct(), "doomed")
    return {
        table: tables[table].delete(found[parent].withColumnRenamed("_gone", column), column)
        for table, column, parent in reversed(children)
    }
