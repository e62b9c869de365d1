"""Watch a folder for comment files and import each new one as a dataset."""

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.ingest import import_comments
from labelmill.sources.comment_csv import RAW_COLUMNS, csv_options, normalize_headers, number_tagged


def dataset_key(file: Column) -> Column:
    """A dataset id that is a function of the file path, so a repeated batch writes the same ids."""
    return F.substring(F.sha2(file, 256), 1, 24)


def read_new_files(
    spark: SparkSession, folder: str, columns: Sequence[str] = RAW_COLUMNS, multiline: bool = True,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """The folder's CSV files as a stream; ``columns`` is the header the files share."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = csv_options(multiline) | {"maxFilesPerTrigger": str(max_files_per_trigger)}
    stream = spark.readStream.schema(schema).options(**options).csv(folder)
    return stream.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def stream_imports(
    files: DataFrame, path: str, checkpoint: str, user: str, strategy: str = "skip",
    as_of: datetime | None = None, **trigger,
):
    """Start the query. Batch N overwrites its own folders of comments, versions, rejects, messages, report and files."""

    def load(batch: DataFrame, number: int) -> None:
        now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        tagged = normalize_headers(batch.withColumn("_scan", F.monotonically_increasing_id()))
        rows = number_tagged(tagged)
        rows = rows.withColumn("dataset_id", dataset_key(F.col("file")))
        result = import_comments(rows.drop("file"), user, now, strategy)
        for name in ("comments", "versions", "rejects", "messages", "report"):
            getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        files_seen = rows.select("dataset_id", "file").distinct()
        files_seen.write.mode("overwrite").parquet(f"{path}/files/batch={number}")

    writer = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
