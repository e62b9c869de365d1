"""Presence from heartbeats: credited time, sessions, the team board, one user's history."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.presence import Cadence, age_status
from labelmill.functions.text import day_key
from labelmill.operators import hotkeys, quality
from labelmill.operators.media import recent_work

SESSION = ["user_id", "session_key"]


def credit_active_time(
    heartbeats: DataFrame, cadence: Cadence = Cadence(), limit: int = hotkeys.KEY_ROW_LIMIT
) -> DataFrame:
    """Heartbeats with ``active_ms`` and ``idle_ms``.

    The time since the session's previous heartbeat, at most two intervals,
    goes to the state that heartbeat claimed; ``away`` time goes to neither.
    """
    timed = heartbeats.withColumn("_ms", F.unix_millis("ts"))
    # A beat's other fields settle the order of beats alike in time and state, so a burst can be cut.
    order = ["ts", "state", *[c for c in ("action", "target_type", "target_id") if c in heartbeats.columns]]
    cut = hotkeys.cut_keys(timed, SESSION, order, limit)
    paired = hotkeys.previous_row(timed, cut, order, ["_ms", "state"], "_prev")
    spent = F.least(F.col("_ms") - F.col("_prev._ms"), F.lit(cadence.credit_cap_ms))

    def credited(state: str) -> Column:
        return F.coalesce(F.when(F.col("_prev.state") == state, spent), F.lit(0)).cast("bigint")

    return paired.withColumns(
        {"active_ms": credited("active"), "idle_ms": credited("idle"), "day": day_key(F.col("ts"))}
    ).drop("_ms", "_prev")


def active_by_day(credited: DataFrame) -> DataFrame:
    """Active time per session and UTC day of the later heartbeat."""
    return credited.groupBy(*SESSION, "day").agg(F.sum("active_ms").alias("active_ms"))


def sessions(credited: DataFrame) -> DataFrame:
    """One row per session, in the shape of ``presence_sessions``.

    ``active_by_date`` holds one entry per day the session was active.
    """
    last = F.struct("ts", "state")
    spoke = F.when(F.col("action").isNotNull(), last)
    rows = credited.groupBy(*SESSION).agg(
        F.max_by("state", last).alias("last_state"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_seen_at"),
        F.max(F.when(F.col("state") == "active", F.col("ts"))).alias("last_active_at"),
        F.sum("active_ms").alias("active_ms"),
        F.sum("idle_ms").alias("idle_ms"),
        F.count("*").alias("heartbeats"),
        F.max_by("action", spoke).alias("last_action"),
        F.max_by("target_type", spoke).alias("last_target_type"),
        F.max_by("target_id", spoke).alias("last_target_id"),
    )
    days = (
        active_by_day(credited)
        .where(F.col("active_ms") > 0)
        .groupBy(*SESSION)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "active_ms")))).alias("active_by_date"))
    )
    empty = F.create_map().cast("map<string,bigint>")
    return rows.join(days, SESSION, "left").withColumn(
        "active_by_date", F.coalesce("active_by_date", empty)
    )


def presence_status(sessions_: DataFrame, as_of: datetime, cadence: Cadence = Cadence()) -> DataFrame:
    """Add ``status``, derived at read time."""
    now = F.lit(as_of).cast("timestamp")
    return sessions_.withColumn("status", age_status(F.col("last_seen_at"), F.col("last_state"), now, cadence))


def _today(as_of: datetime) -> tuple[datetime, datetime]:
    start = datetime(as_of.year, as_of.month, as_of.day)
    return start, start + timedelta(days=1) - timedelta(microseconds=1)


# Which status wins when a user has several sessions.
STATUS_ORDER = ("active", "idle", "away", "offline")


def team_board(
    users: DataFrame, sessions_: DataFrame, comments: DataFrame, annotations: DataFrame,
    as_of: datetime, cadence: Cadence = Cadence(),
) -> DataFrame:
    """One row per user, online first: best status, sessions, active time and output today."""
    start, end = _today(as_of)
    today = start.strftime("%Y-%m-%d")
    order = F.lit(len(STATUS_ORDER) - 1)
    for rank, name in reversed(list(enumerate(STATUS_ORDER))):
        order = F.when(F.col("status") == name, F.lit(rank)).otherwise(order)
    spoke = F.when(F.col("last_action").isNotNull(), F.col("last_seen_at"))
    present = presence_status(sessions_, as_of, cadence).groupBy("user_id").agg(
        F.min(order).alias("_order"),
        F.count_if(F.col("status") != "offline").alias("session_count"),
        F.sum(F.coalesce(F.try_element_at("active_by_date", F.lit(today)), F.lit(0))).alias("active_ms_today"),
        F.max("last_active_at").alias("last_active_at"),
        F.max_by("last_action", spoke).alias("last_action"),
    )
    boxes = quality.annotations_by_user(annotations, start, end).withColumnRenamed("count", "annotations_today")
    texts = quality.comments_by_user(comments, start, end).withColumnRenamed("count", "comments_today")
    joined = (
        users.select("user_id", "name", "email", "role", "is_active")
        .join(present, "user_id", "left")
        .join(boxes, "user_id", "left")
        .join(texts, "user_id", "left")
    )
    zero = ["session_count", "active_ms_today", "annotations_today", "comments_today"]
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)).cast("bigint") for c in zero},
            "_order": F.coalesce("_order", F.lit(len(STATUS_ORDER) - 1)),
        }
    )
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return (
        filled.withColumn("status", F.element_at(names, F.col("_order") + 1))
        .withColumn("output_today", F.col("annotations_today") + F.col("comments_today"))
        .orderBy("_order", "user_id")
        .drop("_order")
    )


def board_totals(board: DataFrame) -> DataFrame:
    """The totals line of the board."""
    return board.agg(
        F.count("*").alias("users"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_ORDER],
        F.sum("active_ms_today").alias("active_ms_today"),
        F.sum("output_today").alias("output_today"),
    )


def user_activity(
    user_id: str, sessions_: DataFrame, comments: DataFrame, annotations: DataFrame,
    assets: DataFrame, as_of: datetime, days: int = 14, recent: int = 15,
) -> dict[str, DataFrame]:
    """``series`` (every day, zeros kept), ``totals`` and the ``recent`` newest annotations of one user."""
    if days < 1:
        raise ValueError("days must be at least 1")
    start = datetime(as_of.year, as_of.month, as_of.day) - timedelta(days=days - 1)
    own = sessions_.where(F.col("user_id") == user_id)
    active = (
        own.select(F.explode("active_by_date").alias("date", "ms"))
        .groupBy("date")
        .agg(F.sum("ms").alias("count"))
    )
    boxes = quality.activity_by_date(annotations.where(F.col("created_by") == user_id), start)
    texts = quality.activity_by_date(
        comments.where(F.col("annotated_by") == user_id), start, at="annotated_at"
    )
    output = boxes.unionByName(texts).groupBy("date").agg(F.sum("count").alias("count"))
    series = quality.dense_timeline(active, as_of, days).withColumnRenamed("count", "active_ms").join(
        quality.dense_timeline(output, as_of, days).withColumnRenamed("count", "output"), "date"
    )
    totals = own.agg(
        F.coalesce(F.sum("active_ms"), F.lit(0)).alias("total_active_ms"),
        F.count("*").alias("session_count"),
    )
    return {
        "series": series, "totals": totals,
        "recent": recent_work(annotations, assets, user_id, recent),
    }
