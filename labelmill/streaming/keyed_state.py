"""The latest row of every key, kept by a stream in hash buckets of files.

A micro-batch reads and writes only the buckets of the keys that it names. Its rows are a new layer of those
buckets; a bucket with ``layers`` layers is written whole instead, so a read opens at most that
many files of a bucket however many batches there were:

    rows/layer=12/bucket=7/part-*.parquet
    manifests/000000000012.json      which layers make up each bucket

Repeating a batch starts from the buckets as they were before it. Layers that no kept manifest names
are removed. Choose ``buckets`` so that one of them suits a task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from labelmill import storage
from labelmill.operators.hotkeys import same_keys
from labelmill.staging import staged

BUCKET = "bucket"
LAYER = "layer"
# Rows that were there before the stream, or were added beside it, belong to no batch.
NO_BATCH = -1


class KeyedState:
    """``schema`` (or its DDL) holds the key columns and the rest of a row; ``expired`` tells which rows to leave out
    once ``clock`` (a number that only grows, given with each batch) has passed them."""

    def __init__(
        self, spark: SparkSession, path: str, key: Sequence[str], schema: StructType | str, buckets: int = 64, layers: int = 8,
        expired=None,
    ):
        self.spark, self.path, self.key = spark, path, list(key)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.layers, self.expired = layers, expired
        self.manifests = storage.Manifests(spark, f"{path}/manifests")
        newest = self.manifests.newest()
        # The number of buckets is fixed once rows are written.
        self.buckets = newest["buckets"] if newest else buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``, at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _before(self, batch: int | None) -> dict:
        """The newest manifest, or that from before ``batch`` with rows added beside the stream since."""
        nothing = {"number": -1, "batch": NO_BATCH, "clock": None, "buckets": self.buckets, "layers": {}}
        kept = self.manifests.kept()
        if not kept:
            return nothing
        if batch is None or kept[-1]["batch"] < batch:
            return kept[-1]
        earlier = [m for m in kept if m["batch"] < batch]
        if not earlier and kept[0]["number"] > 0:
            raise ValueError(f"the state before batch {batch} is no longer kept")
        found = earlier[-1] if earlier else nothing
        for later in kept:
            for b, entries in later["layers"].items():
                held = found["layers"].setdefault(b, [])
                held += [e for e in entries if e[1] == NO_BATCH and e[0] > found["number"] and e not in held]
        return found

    def folders(self, buckets: Sequence[int] | None = None, batch: int | None = None) -> list[str]:
        """The folders that hold the rows of these buckets (all if None) before ``batch`` (now if None)."""
        layers = self._before(batch)["layers"]
        wanted = layers if buckets is None else [str(b) for b in buckets]
        return [f"{self.path}/rows/{LAYER}={e[0]}/{BUCKET}={b}" for b in wanted for e in layers.get(b, [])]

    def rows(self, buckets: Sequence[int] | None = None, batch: int | None = None) -> DataFrame:
        """The latest row of every key."""
        folders = self.folders(buckets, batch)
        schema = StructType([*self.schema.fields]).add(LAYER, LongType()).add(BUCKET, IntegerType())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*folders)
        rest = [f.name for f in self.schema.fields if f.name not in self.key]
        last = found.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.col(LAYER)).alias("_last"))
        last = last.select(*self.key, "_last.*").select(*self.schema.names)
        return self._alive(last, self._before(batch)["clock"])

    def _alive(self, rows: DataFrame, clock: int | None) -> DataFrame:
        if self.expired is None or clock is None:
            return rows
        return rows.where(~F.coalesce(self.expired(clock), F.lit(False)))

    def _store(self, rows: DataFrame, number: int) -> None:
        """``rows`` with their bucket; a bucket is written by one task."""
        rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{self.path}/rows/{LAYER}={number}")

    def _add(self, base: dict, batch: int, number: int, whole: Sequence[int], touched: Sequence[int], clock: int | None) -> None:
        layers = {b: list(entries) for b, entries in base["layers"].items()}
        for b in touched:
            entry = [number, batch]
            layers[str(b)] = [entry] if b in whole else [*layers.get(str(b), []), entry]
        clocks = [c for c in (base["clock"], clock) if c is not None]
        batch = max(base["batch"], batch)
        self.manifests.put(
            {"number": number, "batch": batch, "clock": max(clocks, default=None), "buckets": self.buckets, "layers": layers}
        )
        gone = self.manifests.drop_old()
        if gone:
            named = {e[0] for m in self.manifests.kept() for entries in m["layers"].values() for e in entries}
            for number in {e[0] for m in gone for entries in m["layers"].values() for e in entries} - named:
                storage.remove(self.spark, f"{self.path}/rows/{LAYER}={number}")

    def _next(self) -> int:
        newest = self.manifests.newest()
        return newest["number"] + 1 if newest else 0

    def admit(self, rows: DataFrame) -> None:
        """Add the rows (one a key) whose keys the state lacks. Reads the keys of the whole state, so call it once a start."""
        rows = rows.select(*self.schema.names)
        if self.manifests.newest():
            known = self.rows().select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
            rows = staged(rows.join(known, same_keys(self.key, "_k_"), "left_anti"), "admitted")
            touched = self.buckets_of(rows)
        else:
            touched = list(range(self.buckets))
        if touched:
            number = self._next()
            self._store(rows.withColumn(BUCKET, self.bucket()), number)
            there = {int(n.split("=")[1]) for n in storage.names(self.spark, f"{self.path}/rows/{LAYER}={number}") if "=" in n}
            self._add(self._before(None), NO_BATCH, number, [], [b for b in touched if b in there], None)

    def update(self, batch: int, changed: DataFrame, clock: int | None = None) -> None:
        """Set the rows (one a key) that ``batch`` has changed. ``changed`` is read three times, so stage it."""
        touched = self.buckets_of(changed)
        base = self._before(batch)
        if not touched:
            return
        number = self._next()
        whole = [b for b in touched if len(base["layers"].get(str(b), [])) >= self.layers]
        out = changed.select(*self.schema.names)
        if whole:
            named = changed.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
            rest = self.rows(whole, batch).join(named, same_keys(self.key, "_k_"), "left_anti")
            out = out.unionByName(self._alive(rest, clock))
        self._store(out.withColumn(BUCKET, self.bucket()), number)
        self._add(base, batch, number, whole, touched, clock)
