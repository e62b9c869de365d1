"""Patch stream to versions.

A micro-batch appends its versions under ``versions/batch=N`` and its refused
patches under ``rejects/batch=N``. The comments as they stand are a keyed state under ``state``, of which a batch
reads and writes only the buckets of the comments it names. Repeating a batch overwrites its own
folders and starts from the state before it, so the result is the same.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators import hotkeys
from labelmill.operators.history import apply_annotations
from labelmill.schemas import empty, table_type
from labelmill.staging import staged
from labelmill.streaming.keyed_state import KeyedState

FIELDS = ("text", "sentiment", "type", "status", "note", "annotated_by", "annotated_at")


def comment_state(spark: SparkSession, path: str, buckets: int = 64) -> KeyedState:
    """The comments as the stream has left them."""
    return KeyedState(spark, f"{path}/state", ["comment_id"], table_type("comments"), buckets)


def current_comments(comments: DataFrame, path: str) -> DataFrame:
    """Comments with everything the stream has written, those newer than the stream's as they are."""
    spark = comments.sparkSession
    last = comment_state(spark, path).rows().select(
        "comment_id", F.col("version").alias("_v"), F.struct(*FIELDS).alias("_s")
    )
    newer = F.col("_v") > F.col("version")
    return comments.join(last, "comment_id", "left").withColumns(
        {
            **{f: F.when(newer, F.col(f"_s.{f}")).otherwise(F.col(f)) for f in FIELDS},
            "version": F.when(newer, F.col("_v")).otherwise(F.col("version")),
        }
    ).drop("_v", "_s")


def prepare(spark: SparkSession, path: str) -> None:
    """Create the empty version table, so it can be read before the first batch."""
    empty(spark, "comment_versions").write.mode("overwrite").parquet(f"{path}/versions/batch=-1")


def apply_batch(batch: DataFrame, number: int, options: DataFrame, state: KeyedState, path: str, limit: int) -> None:
    """Write the versions and rejects of one micro-batch and update the state."""
    batch = staged(batch, "patches")
    named = batch.select("comment_id").distinct()
    touched = state.rows(state.buckets_of(batch), number).join(named, "comment_id", "left_semi")
    changes = apply_annotations(staged(touched, "touched"), batch, options, limit=limit)
    versions, rejects = f"{path}/versions/batch={number}", f"{path}/rejects/batch={number}"
    changes.versions.write.mode("overwrite").parquet(versions)
    changes.rejects.write.mode("overwrite").parquet(rejects)
    moved = batch.sparkSession.read.schema("comment_id string").parquet(versions).distinct()
    state.update(number, staged(changes.comments.join(moved, "comment_id", "left_semi"), "changed"))


def stream_apply_annotations(
    patches: DataFrame, comments: DataFrame, options: DataFrame, path: str, checkpoint: str,
    limit: int = hotkeys.KEY_ROW_LIMIT, buckets: int = 64, **trigger,
):
    """Start the query. At each start, comments that the state lacks are added to it; batches read the state alone.

    ``buckets`` counts at the first start only: choose it so that the comments of one suit a task.
    """
    state = comment_state(comments.sparkSession, path, buckets)
    state.admit(comments)

    def apply(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, options, state, path, limit)

    writer = patches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
