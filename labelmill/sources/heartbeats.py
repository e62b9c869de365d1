"""Heartbeat streams."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.presence import STATES
from labelmill.schemas import table_type

# Fixed value: the shape of a session key.
SESSION_KEY = r"^[A-Za-z0-9_-]{8,64}$"


def heartbeat_problem() -> Column:
    """Why a heartbeat is refused, or null."""
    return (
        F.when(F.coalesce("session_key", F.lit("")) == "", F.lit("sessionKey is required"))
        .when(~F.col("session_key").rlike(SESSION_KEY), F.lit("invalid sessionKey"))
        .when(~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), F.lit("invalid state"))
        .when(F.col("user_id").isNull() | F.col("ts").isNull(), F.lit("user and time are required"))
    )


def valid_heartbeats(rows: DataFrame) -> DataFrame:
    return rows.where(heartbeat_problem().isNull())


def read_heartbeats(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files_per_trigger: int = 1000
) -> DataFrame:
    """A stream of valid heartbeats; the trigger size bounds what one micro-batch holds.

    Kafka records parsed to the same columns go through ``valid_heartbeats``.
    """
    stream = (
        spark.readStream.schema(table_type("heartbeats"))
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .format(file_format)
        .load(path)
    )
    return valid_heartbeats(stream)
