"""Version stream to daily activity."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.staging import staged
from labelmill.streaming.keyed_state import KeyedState


def stream_activity_by_date(versions: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """``date, count``. In append mode a day is emitted once the watermark has passed its end; in update
    mode every batch emits the days it changed, the open one too, and ``newest_days`` keeps the last of each."""
    return (
        versions.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.count("*").alias("count"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "count")
    )


def day_state(spark: SparkSession, path: str) -> KeyedState:
    """One row a day: so few that one bucket holds them."""
    return KeyedState(spark, path, ["date"], "date string, count bigint", buckets=1)


def write_days(days: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the query in update mode. A batch adds the days it changed as a layer; repeating it changes nothing, and
    the layers are merged every few batches."""
    state = day_state(days.sparkSession, path)

    def keep(batch: DataFrame, number: int) -> None:
        state.update(number, staged(batch.select("date", "count"), "days"))

    writer = days.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_days(spark: SparkSession, path: str) -> DataFrame:
    """``date, count`` of every day so far, from what ``write_days`` wrote."""
    return day_state(spark, path).rows()
