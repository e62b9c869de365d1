"""Small files and whole folders in shared storage, handled by the driver through Hadoop's file systems.

For documents of a few kilobytes that name table parts, and for removing folders that nothing names
any more. Rows are never read or written here.
"""

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder in order; none if it does not exist."""
    where, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; nothing happens if it does not exist."""
    where, fs = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """False if the new name is taken or the old one gone."""
    where, fs = _at(spark, old)
    target, _ = _at(spark, new)
    fs.mkdirs(target.getParent())
    return bool(not fs.exists(target) and fs.exists(where) and fs.rename(where, target))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Manifests:
    """Numbered documents in a folder, each a whole description of a table; the newest counts.

    A document appears at once under its final name, so a reader finds the table as it was before or
    after a change. The last ``keep`` documents stay for readers that began earlier.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder, keep

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/{number:012d}.json"))

    def newest(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def kept(self) -> list[dict]:
        """All documents, the newest last."""
        return [self.read(n) for n in self.numbers()]

    def put(self, document: dict) -> None:
        """Add ``document`` under its ``number``; raises if another writer was first."""
        part = f"{self.folder}/.{uuid.uuid4().hex}"
        write_text(self.spark, part, json.dumps(document))
        if not rename(self.spark, part, f"{self.folder}/{document['number']:012d}.json"):
            remove(self.spark, part)
            raise RuntimeError(f"another writer has added number {document['number']} to {self.folder}")

    def drop_old(self) -> list[dict]:
        """Remove all documents but the last ``keep``; returns those removed."""
        old = self.numbers()[: -self.keep]
        documents = [self.read(n) for n in old]
        for n in old:
            remove(self.spark, f"{self.folder}/{n:012d}.json")
        return documents
