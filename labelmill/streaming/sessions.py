"""Heartbeat stream to live session rows.

Each micro-batch credits its beats with the batch operators, the last beat of every session that it names being
read from a keyed state, so a session of any length and any number of beats spreads over tasks.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.presence import Cadence
from labelmill.operators import hotkeys, presence
from labelmill.operators.presence import SESSION
from labelmill.staging import staged
from labelmill.streaming.keyed_state import KeyedState

BEAT = ("user_id", "session_key", "state", "ts", "action", "target_type", "target_id")
ROW = (
    "user_id string, session_key string, last_state string, started_at timestamp, last_seen_at timestamp, "
    "last_active_at timestamp, active_ms bigint, idle_ms bigint, heartbeats bigint, active_by_date map<string,bigint>, "
    "last_action string, last_target_type string, last_target_id string"
)
DAY_MS = 86_400_000


def session_state(spark: SparkSession, path: str, cadence: Cadence = Cadence(), buckets: int = 64) -> KeyedState:
    """Live sessions. A session not seen for the retention, by the newest beat's clock, is forgotten."""

    def expired(clock: int) -> Column:
        return F.unix_millis("last_seen_at") < clock - cadence.retention_days * DAY_MS

    return KeyedState(spark, f"{path}/state", SESSION, ROW, buckets, expired=expired)


def live_sessions(spark: SparkSession, path: str, cadence: Cadence = Cadence()) -> DataFrame:
    """All sessions as the stream has left them."""
    return session_state(spark, path, cadence).rows()


def _sum_days(a: str, b: str) -> Column:
    """Two maps with the amounts of common days added up."""
    empty = F.create_map().cast("map<string,bigint>")
    added = F.map_zip_with(
        F.coalesce(F.col(a), empty), F.coalesce(F.col(b), empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    )
    return F.map_from_entries(F.array_sort(F.map_entries(added)))


def continued(beats: DataFrame, held: DataFrame, cadence: Cadence = Cadence(), limit: int = hotkeys.KEY_ROW_LIMIT) -> DataFrame:
    """Rows of the sessions that ``beats`` name, after them; ``held`` has the rows before them.

    A beat earlier than its session's last one counts and credits nothing.
    """
    last = held.select(
        *[F.col(k).alias(f"_h_{k}") for k in SESSION], F.col("last_seen_at").alias("_last_ts"), F.col("last_state").alias("_last_state")
    )
    joined = beats.select(*BEAT).join(last, hotkeys.same_keys(SESSION, "_h_"), "left").drop(*[f"_h_{k}" for k in SESSION])
    marked = joined.withColumn("_late", F.coalesce(F.col("ts") < F.col("_last_ts"), F.lit(False)))
    marked = staged(marked, "beats")
    on_time = marked.where("not _late").select(*BEAT)
    # The last beat before this batch goes first, so that the time since then is credited to its state.
    before = held.select(*SESSION, F.col("last_state").alias("state"), F.col("last_seen_at").alias("ts"))
    before = before.join(marked.select(*SESSION).distinct(), SESSION, "left_semi")
    chain = on_time.unionByName(before, allowMissingColumns=True)
    new = presence.sessions(presence.credit_active_time(chain, cadence, limit))
    late = marked.where("_late").groupBy(*SESSION).agg(F.count("*").alias("_late_beats"), F.min("ts").alias("_late_start"))
    names = [c for c in held.columns if c not in SESSION]
    held = held.select(*SESSION, *[F.col(c).alias(f"_h_{c}") for c in names])
    rows = new.join(held, SESSION, "left").join(late, SESSION, "left")
    known = F.col("_h_heartbeats").isNotNull()
    said = F.col("last_action").isNotNull()

    def sum_of(column: str) -> Column:
        return F.col(column) + F.coalesce(f"_h_{column}", F.lit(0))

    return rows.select(
        *SESSION, "last_state",
        F.least("started_at", "_h_started_at", "_late_start").alias("started_at"), "last_seen_at",
        F.greatest("last_active_at", "_h_last_active_at").alias("last_active_at"),
        sum_of("active_ms").alias("active_ms"), sum_of("idle_ms").alias("idle_ms"),
        # The beat read from the state has been counted before.
        (sum_of("heartbeats") - F.when(known, 1).otherwise(0) + F.coalesce("_late_beats", F.lit(0))).alias("heartbeats"),
        _sum_days("active_by_date", "_h_active_by_date").alias("active_by_date"),
        *[F.when(said, F.col(c)).otherwise(F.col(f"_h_{c}")).alias(c) for c in ("last_action", "last_target_type", "last_target_id")],
    )


def stream_sessions(
    heartbeats: DataFrame, path: str, checkpoint: str, cadence: Cadence = Cadence(), watermark: str = "10 minutes",
    buckets: int = 64, limit: int = hotkeys.KEY_ROW_LIMIT, **trigger,
):
    """Start the query; ``live_sessions`` reads what it has written.

    Beats repeated in all columns within the watermark count once. A batch reads and writes the buckets of its
    own sessions; repeating it changes nothing.
    """
    state = session_state(heartbeats.sparkSession, path, cadence, buckets)
    once = heartbeats.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(BEAT))

    def step(batch: DataFrame, number: int) -> None:
        beats = staged(batch.select(*BEAT), "heartbeats")
        clock = beats.agg(F.max(F.unix_millis("ts"))).first()[0]
        named = beats.select(*SESSION).distinct()
        held = state.rows(state.buckets_of(beats), number).join(named, SESSION, "left_semi")
        state.update(number, staged(continued(beats, staged(held, "sessions"), cadence, limit), "sessions"), clock)

    writer = once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
