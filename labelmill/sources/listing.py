"""Files of a folder, listed and read by tasks: whole files are never held, empty ones are files too.

Paths are those that pyarrow's file systems open: local ones and those of hdfs, s3, gs and abfs.
"""

import hashlib
import os
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from labelmill.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = "path string, length bigint, is_folder boolean"
CHUNK = 4 << 20
# Bytes that one task reads.
TASK_BYTES = 1 << 30


@lru_cache(maxsize=64)
def _remote(scheme: str, host: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def located(uri: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    where = uri.split("://", 1)[1]
    # Object stores name the bucket in their paths, others the host in the file system.
    path = where if parts.scheme in ("s3", "s3a", "gs", "abfs", "abfss") else "/" + where.partition("/")[2]
    return _remote(parts.scheme.replace("s3a", "s3"), parts.netloc), path


class Ranged:
    """Bytes of an open file, read in blocks as they are asked for."""

    def __init__(self, file, size: int, block: int = 1 << 16):
        self.file, self.size, self.block = file, size, block
        self.at, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def part(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.block))
        return self.held[at - self.at : at - self.at + n]

    def find(self, byte: bytes, at: int) -> int:
        while at < self.size:
            part = self.part(at, min(self.block, self.size - at))
            found = part.find(byte)
            if found >= 0:
                return at + found
            at += len(part)
        return -1


def _folder_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def rows(found: list) -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, ["path", "length", "is_folder"])

    for batch in batches:
        found = []
        for uri in batch.column("path").to_pylist():
            system, path = located(uri)
            for info in system.get_file_info(fs.FileSelector(path)):
                # As in Spark's own scans, such names are not data.
                if not info.base_name.startswith(("_", ".")):
                    folder = info.type == fs.FileType.Directory
                    found.append((f"{uri.rstrip('/')}/{info.base_name}", info.size, folder))
            if len(found) > 10_000:
                yield rows(found)
                found = []
        yield rows(found)


def rooted(path: str) -> str:
    """The form in which ``list_files`` names a folder."""
    return f"file:{os.path.abspath(path.removeprefix('file:'))}" if urlsplit(path).scheme in ("", "file") else path


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of every file under a folder, a level of folders at a time."""
    level = spark.createDataFrame([(rooted(path),)], "path string")
    files = spark.createDataFrame([], "path string, length bigint")
    while True:
        found = staged(level.mapInArrow(_folder_entries, LISTED), "listed")
        files = files.unionByName(found.where("not is_folder").select("path", "length"))
        folders = found.where("is_folder").select("path")
        n = folders.count()
        if not n:
            return files
        level = folders.repartition(min(n, spark.sparkContext.defaultParallelism * 4), "path")


def sha256_of(file) -> str:
    digest = hashlib.sha256()
    file.seek(0)
    while chunk := file.read(CHUNK):
        digest.update(chunk)
    return digest.hexdigest()


def read_each(files: DataFrame, read: Callable, fields: str) -> DataFrame:
    """``files`` (path, length, …) with the columns ``fields`` (DDL) that ``read(file, row)`` returns as a tuple.

    Files are dealt to tasks of about a gigabyte; ``file`` is open for reads at any place.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                system, path = located(row["path"])
                with system.open_input_file(path) as file:
                    out.append(row | dict(zip(names, read(file, row))))
            yield pa.RecordBatch.from_pylist(out, schema)

    files = staged(files, "files")
    total, most = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    whole = files.limit(0).selectExpr("*", *[f"CAST(NULL AS {f.split(None, 1)[1]}) AS {f.split()[0]}" for f in fields.split(", ")]).schema
    schema = to_arrow_schema(whole)
    tasks = max(1, min(most, max(total // TASK_BYTES + 1, files.sparkSession.sparkContext.defaultParallelism)))
    return files.repartition(int(tasks), "path").mapInArrow(opened, whole)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, checksum``: the SHA-256 of every file's bytes, streamed."""
    found = read_each(list_files(spark, path), lambda file, row: (sha256_of(file),), "checksum string")
    return found.select(F.col("path").alias("file"), "length", "checksum")
