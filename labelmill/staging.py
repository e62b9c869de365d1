"""Written intermediate tables in the shared checkpoint folder.

A staged table fixes a layout (so positions computed from it never change) and
cuts lineage: a lost executor re-reads files instead of recomputing. Results are lazy and read
these tables, so they stay until the caller is done: within ``scratch`` they go at its end.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from labelmill import storage

_SCRATCH = "labelmill.scratch"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to a folder of their own, which is removed at the end, also after an error.

        with scratch(spark):
            reports.dataset_report(datasets, comments).write.parquet(path)
    """
    outer = spark.conf.get(_SCRATCH, "")
    folder = shared_dir(spark)
    name = f"scratch-{uuid.uuid4().hex}"
    spark.conf.set(_SCRATCH, f"{outer}/{name}")
    try:
        yield f"{folder}/{name}"
    finally:
        spark.conf.set(_SCRATCH, outer)
        storage.remove(spark, f"{folder}/{name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or that of the ``scratch`` around; a private one only for local runs
    without it."""
    return _checkpoint_dir(spark) + spark.conf.get(_SCRATCH, "")


def _checkpoint_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="labelmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back with its own schema. ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
