"""Preparing a session for the corpus operators: their code on the executors, and bounded Arrow batches."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import labelmill

_SENT: set[str] = set()

# Spark's default lets a batch of texts grow to 64 MB, several copies of which live in a worker and its JVM.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per application, and bound its
    Arrow batches where the session leaves them at the default.

    Spark itself copies the archive to every executor.
    """
    key, default, bound = BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, bound)
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = Path(labelmill.__file__).parent
    folder = tempfile.mkdtemp(prefix="labelmill-code-")
    archive = os.path.join(folder, "labelmill_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, str(source.relative_to(top.parent)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)
