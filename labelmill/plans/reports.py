"""Dataset, global and workspace reports, each over every dataset in one job."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.numbers import half_up, percent
from labelmill.functions.text import LENGTH_BOUNDS, length_bucket, near_dup_key
from labelmill.operators import quality
from labelmill.plans.readiness import readiness, warnings
from labelmill.staging import staged


# Parts of a dataset's counts.
STATUS, SENTIMENT, TYPE, LENGTH, COPIES, ACTIVITY = "status", "sentiment", "type", "length", "copies", "activity"


def dataset_counts(comments: DataFrame, near_chars: int | None = None) -> DataFrame:
    """``dataset_id, part, pos, label, count``: every count of the reports, from one scan of the texts.

    The scan leaves a narrow row per comment, with a digest in place of the text. It folds to the
    product of the vocabularies, and each figure to one row per label, length bucket or status.
    """
    bucket = length_bucket(F.length(F.coalesce("text", F.lit(""))), LENGTH_BOUNDS)
    narrow = staged(
        comments.select(
            "dataset_id", "sentiment", "type", "status", bucket.alias("bucket"),
            F.unhex(F.md5(near_dup_key(F.col("text"), near_chars))).alias("near"),
        ),
        "narrow",
    )
    keys = ["dataset_id", "sentiment", "type", "status", "bucket"]
    cube = narrow.groupBy(*keys).agg(F.count("*").alias("count"))

    def part(name: str, label: Column, pos: Column | None = None) -> Column:
        place = F.lit(0) if pos is None else pos
        return F.struct(F.lit(name).alias("part"), place.cast("int").alias("pos"), label.cast("string").alias("label"))

    parts = F.array(
        part(STATUS, F.col("status")), part(SENTIMENT, F.col("sentiment")), part(TYPE, F.col("type")),
        part(LENGTH, F.col("bucket.label"), F.col("bucket.pos")),
    )
    counts = (
        cube.select("dataset_id", F.explode(parts).alias("p"), "count")
        .groupBy("dataset_id", "p.part", "p.pos", "p.label")
        .agg(F.sum("count").alias("count"))
    )
    copies = narrow.where(F.col("near").isNotNull()).groupBy("dataset_id", "near").agg(F.count("*").alias("_n"))
    copies = copies.groupBy("dataset_id").agg(F.sum(F.col("_n") - 1).alias("count"))
    copies = copies.select(
        "dataset_id", F.lit(COPIES).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("label"), "count"
    )
    return counts.unionByName(copies)


def _axis_figures(part: str, prefix: str) -> list[Column]:
    """Class balance of one vocabulary, as aggregates over a dataset's counts."""
    of = (F.col("part") == part) & F.col("label").isNotNull() & (F.col("count") > 0)
    count, share = F.when(of, F.col("count")), F.when(of, F.col("_share"))
    classes = F.count(count)
    most = F.when(classes > 1, F.log2(classes.cast("double")))
    entropy = F.sum(-share * F.log2(share))
    order = F.when(of, F.struct(-F.col("count"), F.col("label")))
    figures = {
        "total": F.sum(count), "classes": classes, "max": F.max(count), "min": F.min(count),
        "imbalance_ratio": half_up(F.max(count) / F.min(count), 2),
        "entropy": half_up(entropy, 3),
        "max_entropy": F.when(classes > 0, F.coalesce(half_up(most, 3), F.lit(0.0))),
        "balance_score": F.coalesce(half_up(entropy / most, 3), F.lit(1.0)),
        "gini": half_up(1 - F.sum(share * share), 3),
        "top": F.min_by("label", order), "bottom": F.max_by("label", order),
    }
    return [c.alias(f"{prefix}_{n}") for n, c in figures.items()]


def _listed(name: str, part: str, *fields: Column, labelled: bool = False) -> Column:
    of = F.col("part") == part
    if labelled:
        of = of & F.col("label").isNotNull()
    return F.array_sort(F.collect_list(F.when(of, F.struct(*fields)))).alias(name)


def _one_per_dataset(datasets: DataFrame, counts: DataFrame, *more: Column) -> DataFrame:
    """Every figure in one aggregate over the counts and one join to the datasets."""
    per_part = Window.partitionBy("dataset_id", "part")
    known = F.when(F.col("label").isNotNull(), F.col("count"))
    placed = counts.withColumns(
        {
            "_share": F.col("count") / F.sum(known).over(per_part),
            "percent": percent(F.col("count"), F.sum(known).over(per_part)),
            # Null labels come last, so they take no rank from others.
            "rank": F.row_number().over(per_part.orderBy(F.col("label").isNull(), F.col("count").desc(), "label")),
        }
    )

    def status(name: str) -> Column:
        return F.sum(F.when((F.col("part") == STATUS) & (F.col("label") == name), F.col("count")).otherwise(0)).alias(name)

    figures = placed.groupBy("dataset_id").agg(
        F.sum(F.when(F.col("part") == STATUS, F.col("count")).otherwise(0)).alias("total"),
        status("annotated"), status("pending"),
        F.sum(F.when(F.col("part") == COPIES, F.col("count")).otherwise(0)).alias("duplicate_count"),
        *_axis_figures(SENTIMENT, "s"), *_axis_figures(TYPE, "t"), *more,
    )
    joined = datasets.join(figures, "dataset_id", "left")
    zero = ["total", "annotated", "pending", "duplicate_count", "s_classes", "t_classes"]
    one = ["s_balance_score", "t_balance_score"]
    return joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in zero},
            **{c: F.coalesce(c, F.lit(1.0)) for c in one},
            "percent_annotated": percent(F.col("annotated"), F.col("total")),
        }
    )


def dataset_summary(datasets: DataFrame, comments: DataFrame, near_chars: int | None = None) -> DataFrame:
    """One row per dataset with everything readiness and warnings need.

    ``near_chars`` is how many characters decide a near copy; all of them by default.
    """
    return _one_per_dataset(datasets, dataset_counts(comments, near_chars))


def dataset_readiness(datasets: DataFrame, comments: DataFrame, near_chars: int | None = None) -> DataFrame:
    summary = dataset_summary(datasets, comments, near_chars)
    return summary.select("dataset_id", readiness().alias("r")).select("dataset_id", "r.*")


def dataset_warnings(datasets: DataFrame, comments: DataFrame, near_chars: int | None = None) -> DataFrame:
    """One row per warning."""
    listed = dataset_summary(datasets, comments, near_chars).select(
        "dataset_id", F.posexplode(warnings()).alias("pos", "w")
    )
    return listed.select("dataset_id", "pos", "w.*")


def dataset_report(
    datasets: DataFrame, comments: DataFrame, versions: DataFrame, near_chars: int | None = None
) -> DataFrame:
    """The whole report, one row per dataset.

    The nested lists hold vocabulary entries, length buckets and days: as many
    as there are labels, bounds and calendar days, not rows.
    """
    daily = quality.activity_by_dataset(versions, comments)
    days = daily.select(
        "dataset_id", F.lit(ACTIVITY).alias("part"), F.lit(0).alias("pos"), F.col("date").alias("label"), "count"
    )
    count, label = F.col("count"), F.col("label")
    ranked = (F.col("rank"), label, count, F.col("percent"))
    return (
        _one_per_dataset(
            datasets, dataset_counts(comments, near_chars).unionByName(days),
            _listed("status_breakdown", STATUS, F.coalesce(label, F.lit("unknown")).alias("status"), count),
            _listed("sentiment", SENTIMENT, *ranked, labelled=True),
            _listed("type", TYPE, *ranked, labelled=True),
            _listed("length_histogram", LENGTH, F.col("pos"), label, count),
            _listed("activity", ACTIVITY, label.alias("date"), count),
        )
        .withColumn("readiness", readiness())
        .withColumn("warnings", warnings())
    )


def _one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side, by union and maximum instead of a join."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _totals(comments: DataFrame, datasets: DataFrame, *more: DataFrame) -> DataFrame:
    counted = comments.agg(*quality.status_aggregates())
    sets = datasets.agg(F.count("*").alias("total_datasets"))
    return _one_row(counted, sets, *more).withColumn(
        "percent_annotated", percent(F.col("annotated"), F.col("total"))
    )


def global_overview(comments: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """One row of totals."""
    people = quality.user_counts(users).select("total_users", "active_users")
    return _totals(comments, datasets, people).select(
        F.col("total").alias("total_comments"), F.col("annotated").alias("annotated_comments"),
        F.col("pending").alias("pending_comments"), "total_datasets", "total_users",
        "active_users", "percent_annotated",
    )


def global_report(
    comments: DataFrame, versions: DataFrame, datasets: DataFrame, users: DataFrame, as_of: datetime
) -> dict[str, DataFrame]:
    """Totals, label balance, 14 days of activity, dataset statuses and the ten largest datasets."""
    since = as_of - timedelta(days=14)
    labels = {
        axis: quality.group_by_field(comments, axis).withColumn("axis", F.lit(axis))
        for axis in ("sentiment", "type")
    }
    both = labels["sentiment"].unionByName(labels["type"])
    return {
        "overview": global_overview(comments, datasets, users),
        "balance": quality.summarize(both, ["axis"]),
        "labels": quality.distribution(both, ["axis"]),
        "activity": quality.dense_timeline(quality.activity_by_date(versions, since), as_of, 14),
        "dataset_statuses": quality.dataset_status_counts(datasets),
        "top_datasets": quality.top_datasets(datasets, comments, 10),
    }


def workspace_stats(
    comments: DataFrame, versions: DataFrame, datasets: DataFrame, users: DataFrame, as_of: datetime
) -> dict[str, DataFrame]:
    """Totals with a zero-filled status count, and the last seven days of activity."""
    statuses = datasets.agg(
        *[
            F.count_if(F.col("status") == s).alias(f"datasets_{s}")
            for s in ("pending", "processing", "completed", "failed")
        ]
    )
    people = quality.user_counts(users).select("active_annotators")
    return {
        "totals": _totals(comments, datasets, people, statuses),
        "activity": quality.activity_by_date(versions, as_of - timedelta(days=7)),
    }
