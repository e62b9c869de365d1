"""Label-quality counts over comments, versions, datasets and users."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.labels import ANNOTATED, PENDING
from labelmill.functions.numbers import half_up, percent
from labelmill.functions.text import LENGTH_BOUNDS, day_key, length_bucket, near_dup_key


def group_by_field(comments: DataFrame, field: str, dataset_id: str | None = None) -> DataFrame:
    """``label, count`` for one field; a null label is its own row. No dataset means all."""
    rows = comments.where(F.col("dataset_id") == dataset_id) if dataset_id else comments
    return rows.groupBy(F.col(field).cast("string").alias("label")).agg(F.count("*").alias("count"))


def label_counts(comments: DataFrame, field: str) -> DataFrame:
    """``dataset_id, label, count`` for every dataset."""
    return comments.groupBy("dataset_id", F.col(field).cast("string").alias("label")).agg(
        F.count("*").alias("count")
    )


def status_aggregates() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("status") == ANNOTATED).alias("annotated"),
        F.count_if(F.col("status") == PENDING).alias("pending"),
    ]


def count_by_status(comments: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return comments.groupBy(*by).agg(*status_aggregates())


def length_histogram(comments: DataFrame, bounds: Sequence[int] = LENGTH_BOUNDS) -> DataFrame:
    """Non-empty length buckets per dataset, with ``pos`` giving the bucket order."""
    length = F.length(F.coalesce("text", F.lit("")))
    return (
        comments.select("dataset_id", length_bucket(length, bounds).alias("b"))
        .groupBy("dataset_id", F.col("b.pos").alias("pos"), F.col("b.label").alias("label"))
        .agg(F.count("*").alias("count"))
    )


def summarize(counts: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Class-balance figures per key from ``label, count`` rows; null labels do not count.

    ``counts`` holds one row per key and label, so the window below sees a
    vocabulary, never the facts.
    """
    kept = counts.where(F.col("label").isNotNull())
    if exclude:
        kept = kept.where(~F.col("label").isin(list(exclude)))
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    stats = (
        kept.where(F.col("count") > 0)
        .withColumn("_p", share)
        .groupBy(*keys)
        .agg(
            F.sum("count").alias("total"),
            F.count("*").alias("classes"),
            F.max("count").alias("max"),
            F.min("count").alias("min"),
            F.sum(-F.col("_p") * F.log2("_p")).alias("_h"),
            (1 - F.sum(F.col("_p") * F.col("_p"))).alias("_g"),
        )
    )
    most = F.when(F.col("classes") > 1, F.log2(F.col("classes").cast("double")))
    return stats.select(
        *keys, "total", "classes", "max", "min",
        half_up(F.col("max") / F.col("min"), 2).alias("imbalance_ratio"),
        half_up(F.col("_h"), 3).alias("entropy"),
        F.coalesce(half_up(most, 3), F.lit(0.0)).alias("max_entropy"),
        F.coalesce(half_up(F.col("_h") / most, 3), F.lit(1.0)).alias("balance_score"),
        half_up(F.col("_g"), 3).alias("gini"),
    )


def distribution(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each label within its key, with ``rank`` by count (ties by label)."""
    per_key = Window.partitionBy(*keys)
    ranked = per_key.orderBy(F.col("count").desc(), "label")
    return counts.where(F.col("label").isNotNull()).select(
        *keys, "label", "count",
        percent(F.col("count"), F.sum("count").over(per_key)).alias("percent"),
        F.row_number().over(ranked).alias("rank"),
    )


def class_balance(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total boxes and entropy over log2(classes), two decimals, 0 for one class."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    stats = histogram.withColumn("_p", share).groupBy(*keys).agg(
        F.sum("count").alias("total_boxes"),
        F.count("*").alias("classes"),
        F.sum(-F.col("_p") * F.log2("_p")).alias("_h"),
    )
    most = F.when(F.col("classes") > 1, F.log2(F.col("classes").cast("double")))
    return stats.select(
        *keys, "total_boxes",
        F.coalesce(half_up(F.col("_h") / most, 2), F.lit(0.0)).alias("class_balance"),
    )


def near_duplicate_count(
    comments: DataFrame, by: Sequence[str] = ("dataset_id",), chars: int | None = None
) -> DataFrame:
    """Texts beyond the first that are the same but for case and outer white space, per group.

    With ``chars`` only so many characters decide. Copies fold map-side into one row per text,
    known by a digest, so neither copies nor long texts travel.
    """
    key = near_dup_key(F.col("text"), chars)
    openings = (
        comments.select(*by, F.sha2(key, 256).alias("_key"))
        .groupBy(*by, "_key")
        .agg(F.count("*").alias("_n"))
    )
    extra = F.when(F.col("_key").isNotNull(), F.col("_n") - 1).otherwise(F.lit(0))
    return openings.groupBy(*by).agg(F.sum(extra).alias("duplicate_count"))


def activity_by_date(
    versions: DataFrame, since: datetime | None = None, by: Sequence[str] = (), at: str = "created_at"
) -> DataFrame:
    """Rows per UTC day, days without rows absent."""
    rows = versions.where(F.col(at) >= F.lit(since)) if since else versions.where(F.col(at).isNotNull())
    return rows.groupBy(*by, day_key(F.col(at)).alias("date")).agg(F.count("*").alias("count"))


def versions_with_dataset(versions: DataFrame, comments: DataFrame) -> DataFrame:
    """Version rows with their comment's dataset; versions of deleted comments drop out."""
    return versions.join(comments.select("comment_id", "dataset_id"), "comment_id")


def activity_by_dataset(versions: DataFrame, comments: DataFrame) -> DataFrame:
    """Version rows per dataset and day; versions of deleted comments drop out.

    Versions fold to one row per comment and day before the join, so a much
    edited comment stays small.
    """
    daily = activity_by_date(versions, by=["comment_id"])
    owned = daily.join(comments.select("comment_id", "dataset_id"), "comment_id")
    return owned.groupBy("dataset_id", "date").agg(F.sum("count").alias("count"))


def dense_timeline(activity: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Exactly ``days`` days ending on ``as_of``, zero-filled."""
    if days < 1:
        raise ValueError("days starts at 1")
    last = F.to_date(F.lit(as_of.strftime("%Y-%m-%d")))
    calendar = activity.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("_d")
    )
    calendar = calendar.select(F.date_format("_d", "yyyy-MM-dd").alias("date"))
    return calendar.join(activity, "date", "left").select(
        "date", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def dataset_status_counts(datasets: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    return datasets.groupBy(status.alias("status")).agg(F.count("*").alias("count"))


def user_counts(users: DataFrame) -> DataFrame:
    active = F.col("is_active")
    return users.agg(
        F.count("*").alias("total_users"),
        F.count_if(active).alias("active_users"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(active & (F.col("role") == "annotator")).alias("active_annotators"),
    )


def datasets_with_counts(datasets: DataFrame, comments: DataFrame) -> DataFrame:
    """Every dataset with its comment counts, zeros included; counts are folded before the join."""
    joined = datasets.join(count_by_status(comments), "dataset_id", "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("total", "annotated", "pending")}
    ).orderBy(F.col("created_at").desc(), "dataset_id")


def top_datasets(datasets: DataFrame, comments: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` datasets with most comments."""
    counted = datasets.join(count_by_status(comments), "dataset_id").select(
        "dataset_id", "name", "status", "total", "annotated",
        percent(F.col("annotated"), F.col("total")).alias("percent"),
    )
    return counted.orderBy(F.col("total").desc(), "dataset_id").limit(n)


def output_by_user(
    rows: DataFrame, user: str, at: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Work items per user in an inclusive time window, sorted by user."""
    kept = rows.where(F.col(user).isNotNull() & (F.col(user) != ""))
    if start:
        kept = kept.where(F.col(at) >= F.lit(start))
    if end:
        kept = kept.where(F.col(at) <= F.lit(end))
    return kept.groupBy(F.col(user).alias("user_id")).agg(F.count("*").alias("count")).orderBy("user_id")


def comments_by_user(comments: DataFrame, start=None, end=None) -> DataFrame:
    return output_by_user(comments, "annotated_by", "annotated_at", start, end)


def annotations_by_user(annotations: DataFrame, start=None, end=None) -> DataFrame:
    return output_by_user(annotations, "created_by", "created_at", start, end)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Values in use, sorted, without null."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
