"""Text files in zip archives, read by tasks line by line."""

import io
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.sources.listing import TASK_BYTES, list_files, located, rooted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = 10_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``folder, file, line`` of the files in the archives under ``path``; ``folder`` is where the archive lies in it."""
    root = rooted(path).rstrip("/")

    def lines(uri: str) -> Iterator[tuple[str, str, str]]:
        folder = uri[len(root) + 1 :].rpartition("/")[0]
        system, at = located(uri)
        with system.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
            for member in archive.infolist():
                with io.TextIOWrapper(archive.open(member), "utf-8", newline="\n") as text:
                    for line in text:
                        yield folder, member.filename, line.removesuffix("\n")

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["folder", "file", "line"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for paths in batches:
            for uri in paths.column("path").to_pylist():
                for row in lines(uri):
                    rows.append(row)
                    if len(rows) >= LINES:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    files = list_files(spark, path).where(F.col("path").endswith(".zip"))
    total, most = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(most, max(total // TASK_BYTES + 1, spark.sparkContext.defaultParallelism * 4)))
    return files.select("path").repartition(int(tasks), "path").mapInArrow(opened, "folder string, file string, line string")
