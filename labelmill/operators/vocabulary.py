"""Taxonomies and label sets: allowed labels, class lists, label checks and normalisation.

A vocabulary joined to facts is broadcast only when its measured size allows;
beyond that the join is a shuffle whose skew AQE splits.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.labels import (
    DEFAULT_SENTIMENTS, DEFAULT_TYPES, NO_SENTIMENT, NO_TYPE, class_slug, label_color,
)
from labelmill.functions.text import slug, trimmed
from labelmill.operators.sizes import broadcast_if_small


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _with_taxonomy(datasets: DataFrame, taxonomies: DataFrame) -> DataFrame:
    terms = taxonomies.select(
        "taxonomy_id", F.col("name").alias("_name"), "sentiment", "type", F.lit(True).alias("_found")
    )
    return datasets.select("dataset_id", "taxonomy_id").join(terms, "taxonomy_id", "left")


def valid_options(datasets: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """``dataset_id, sentiments, types``: allowed labels."""

    def allowed(terms: str, defaults, fallback) -> Column:
        values = F.transform(F.col(terms), lambda t: t["value"])
        chosen = F.when(F.size(F.coalesce(values, F.array())) > 0, values).otherwise(_strings(defaults))
        return F.array_union(chosen, F.array(F.lit(fallback)))

    return _with_taxonomy(datasets, taxonomies).select(
        "dataset_id",
        allowed("sentiment", DEFAULT_SENTIMENTS, NO_SENTIMENT).alias("sentiments"),
        allowed("type", DEFAULT_TYPES, NO_TYPE).alias("types"),
    )


def dataset_taxonomy(datasets: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """The ordered labels in force, one row per dataset, axis and term."""

    def listed(terms: str, defaults) -> Column:
        standard = F.array(
            *[
                F.struct(F.lit(v).alias("value"), F.lit(v).alias("label"), F.lit(float(i)).alias("order"))
                for i, v in enumerate(defaults)
            ]
        )
        return F.when(F.col("_found"), F.col(terms)).otherwise(standard)

    joined = _with_taxonomy(datasets, taxonomies).select(
        "dataset_id", "taxonomy_id",
        F.coalesce("_name", F.lit("Default")).alias("taxonomy_name"),
        F.create_map(
            F.lit("sentiment"), listed("sentiment", DEFAULT_SENTIMENTS),
            F.lit("type"), listed("type", DEFAULT_TYPES),
        ).alias("axes"),
    )
    axes = joined.select("dataset_id", "taxonomy_id", "taxonomy_name", F.explode("axes").alias("axis", "terms"))
    return axes.select(
        "dataset_id", "taxonomy_id", "taxonomy_name", "axis", F.posexplode("terms").alias("position", "term")
    ).select("dataset_id", "taxonomy_id", "taxonomy_name", "axis", "position", "term.value", "term.label")


def check_labels(rows: DataFrame, options: DataFrame) -> DataFrame:
    """Add ``bad_label``: which axis of (sentiment, type) holds a label its dataset does not allow.

    A null label means "not set" and passes. Datasets without options fail.
    """
    joined = rows.join(broadcast_if_small(options), "dataset_id", "left")

    def refused(label: str, allowed: str) -> Column:
        known = F.coalesce(F.array_contains(F.col(allowed), F.col(label)), F.lit(False))
        return F.col(label).isNotNull() & ~known

    bad = F.when(refused("sentiment", "sentiments"), "sentiment").when(refused("type", "types"), "type")
    return joined.withColumn("bad_label", bad).drop("sentiments", "types")


def class_list(media_datasets: DataFrame, label_sets: DataFrame) -> DataFrame:
    """``dataset_id, class_id, value, name`` in declared order; unused classes stay."""
    bound = media_datasets.select("dataset_id", "label_set_id").join(
        label_sets.select("label_set_id", "labels"), "label_set_id"
    )
    return bound.select("dataset_id", F.posexplode("labels").alias("class_id", "l")).select(
        "dataset_id", "class_id", F.col("l.value").alias("value"), F.col("l.label").alias("name")
    )


def without_label_set(media_datasets: DataFrame, label_sets: DataFrame) -> DataFrame:
    """Datasets that cannot be exported: no label set, or one that is gone."""
    return media_datasets.join(label_sets, "label_set_id", "left_anti").select("dataset_id")


def resolve_labels(rows: DataFrame, classes: DataFrame, wanted: str = "label") -> DataFrame:
    """Add ``value`` and ``class_id``: by class value first, else by display text in any case."""
    asked = rows.withColumn("_wanted", trimmed(F.coalesce(F.col(wanted), F.lit(""))))
    by_value = classes.select(
        "dataset_id", F.col("value").alias("_wanted"),
        F.struct(F.col("class_id").alias("class_id"), F.col("value").alias("value")).alias("_exact"),
    )
    by_name = (
        classes.groupBy("dataset_id", F.lower("name").alias("_name"))
        .agg(F.min(F.struct("class_id", "value")).alias("_display"))
    )
    hit = (
        asked.join(broadcast_if_small(by_value), ["dataset_id", "_wanted"], "left")
        .withColumn("_name", F.lower("_wanted"))
        .join(broadcast_if_small(by_name), ["dataset_id", "_name"], "left")
        .withColumn("_hit", F.coalesce("_exact", "_display"))
    )
    reason = (
        F.when(F.col("_wanted") == "", F.lit("A label is required"))
        .when(
            F.col("_hit").isNull(),
            F.concat(F.lit('"'), F.col("_wanted"), F.lit('" is not a label in this dataset\'s label set')),
        )
    )
    return hit.withColumns(
        {"value": F.col("_hit.value"), "class_id": F.col("_hit.class_id"), "label_error": reason}
    ).drop("_wanted", "_name", "_exact", "_display", "_hit")


def orphaned_labels(
    current: DataFrame, following: DataFrame, media_datasets: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Classes dropped from a label set that a bound dataset still uses, with their use count.

    ``current`` and ``following`` are label set tables before and after an edit.
    """

    def values(sets: DataFrame) -> DataFrame:
        return sets.select("label_set_id", F.explode("labels").alias("l")).select(
            "label_set_id", F.col("l.value").alias("label")
        )

    removed = values(current).join(values(following), ["label_set_id", "label"], "left_anti")
    bound = removed.join(media_datasets.select("dataset_id", "label_set_id"), "label_set_id")
    used = annotations.groupBy("dataset_id", "label").agg(F.count("*").alias("count"))
    return used.join(bound.select("dataset_id", "label").distinct(), ["dataset_id", "label"])


def usage_count(vocabulary: DataFrame, bound: DataFrame, key: str, name: str) -> DataFrame:
    """How many rows of ``bound`` use each vocabulary entry (0 means safe to delete)."""
    used = bound.groupBy(key).agg(F.count("*").alias(name))
    return vocabulary.select(key).join(used, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def assignment_load(users: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets assigned to each user."""
    held = datasets.select(F.col("assigned_to").alias("user_id"))
    return usage_count(users, held, "user_id", "assigned_datasets")


def scope_to_user(rows: DataFrame, datasets: DataFrame, user_id: str, admin: bool = False) -> DataFrame:
    """An admin sees every row, anyone else the rows of datasets assigned to them."""
    if admin:
        return rows
    return rows.join(datasets.where(F.col("assigned_to") == user_id), "dataset_id", "left_semi")


def _long_lists(items: DataFrame, keys: list[str], most: int | None) -> tuple[DataFrame, DataFrame]:
    """(items of the other lists, lists over the limit); found by count, so a refused list is never gathered."""
    if most is None:
        return items, items.select(*keys).limit(0)
    big = items.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n")
    return items.join(big, keys, "left_anti"), big


def normalize_terms(items: DataFrame, max_terms: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Taxonomy items (taxonomy_id, axis, idx, label, value, order) to one checked list per axis.

    Output: taxonomy_id, axis, terms (null when refused), error (the first problem). ``max_terms``
    and ``max_chars`` refuse longer lists and labels; nothing is cut.
    """
    keys = ["taxonomy_id", "axis"]
    fits, big = _long_lists(items, keys, max_terms)
    label = F.nullif(trimmed(F.col("label")), F.lit(""))
    given = F.nullif(F.col("value"), F.lit(""))
    named = fits.withColumn("label", label).withColumn(
        "value", F.when(F.col("label").isNotNull(), slug(F.coalesce(given, F.col("label"))))
    )
    # A vocabulary becomes one value of a row below, so a task can hold it.
    seen = F.row_number().over(Window.partitionBy(*keys, "value").orderBy("idx"))
    place = F.concat(F.col("axis"), F.lit("["), F.col("idx").cast("string"), F.lit("]"))
    problem = (
        F.when(F.col("label").isNull(), F.concat(place, F.lit(".label is required")))
        .when(
            F.length("label") > (max_chars if max_chars is not None else F.length("label")),
            F.concat(place, F.lit(f".label exceeds {max_chars} characters")),
        )
        .when(
            F.col("value") == "",
            F.concat(place, F.lit('.value could not be derived from label "'), F.col("label"), F.lit('"')),
        )
        .when(
            F.col("_seen") > 1,
            F.concat(F.col("axis"), F.lit(' has duplicate value "'), F.col("value"), F.lit('"')),
        )
    )
    placed = named.withColumn("_seen", seen).withColumn("_problem", problem)
    order = F.coalesce(F.col("order").cast("double"), F.col("idx").cast("double"))
    entry = F.struct(
        order.alias("order"), F.col("idx"),
        F.struct(F.col("value"), F.col("label"), order.alias("order")).alias("t"),
    )
    lists = placed.groupBy(*keys).agg(
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("idx"))).alias("error"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]).alias("_terms"),
    )
    closing = F.when(F.col("axis") == "sentiment", F.lit(NO_SENTIMENT)).otherwise(F.lit(NO_TYPE))
    closing_label = F.when(F.col("axis") == "sentiment", F.lit("Unannotated")).otherwise(F.lit("Unclassified"))
    has_closing = F.exists("_terms", lambda t: t["value"] == closing)
    extra = F.array(
        F.struct(closing.alias("value"), closing_label.alias("label"), F.lit(999.0).alias("order"))
    )
    full = F.when(has_closing, F.col("_terms")).otherwise(F.concat("_terms", extra))
    checked = lists.select(*keys, F.when(F.col("error").isNull(), full).alias("terms"), "error")
    refused = big.select(
        *keys,
        F.lit(None).cast("array<struct<value:string,label:string,order:double>>").alias("terms"),
        F.concat(F.col("axis"), F.lit(f" cannot have more than {max_terms} items")).alias("error"),
    )
    return checked.unionByName(refused)


def normalize_classes(items: DataFrame, max_classes: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Label-set items (label_set_id, idx, label, value, color) to one checked class list.

    Output: label_set_id, labels (null when refused), error (the first problem). ``max_classes``
    and ``max_chars`` refuse longer lists and labels; nothing is cut.
    """
    keys = ["label_set_id"]
    fits, big = _long_lists(items, keys, max_classes)
    named = fits.withColumn("label", trimmed(F.coalesce(F.col("label"), F.lit("")))).withColumn(
        "value", class_slug(F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("label")))
    )
    # A class list becomes one value of a row below, so a task can hold it.
    seen = F.row_number().over(Window.partitionBy(*keys, "value").orderBy("idx"))
    said = F.concat(F.lit('Label "'), F.col("label"), F.lit('"'))
    problem = (
        F.when(
            F.col("label") == "",
            F.concat(F.lit("Label "), (F.col("idx") + 1).cast("string"), F.lit(" is empty")),
        )
        .when(
            F.length("label") > (max_chars if max_chars is not None else F.length("label")),
            F.concat(said, F.lit(f" exceeds {max_chars} characters")),
        )
        .when(F.col("value") == "", F.concat(said, F.lit(" has no usable characters for a class name")))
        .when(
            F.col("_seen") > 1,
            F.concat(
                F.lit('Duplicate class name "'), F.col("value"),
                F.lit('" — every label needs a unique value'),
            ),
        )
    )
    color = F.coalesce(F.nullif(F.col("color"), F.lit("")), label_color(F.col("idx")))
    entry = F.struct(
        F.col("idx"), F.struct(F.col("value"), F.col("label"), color.alias("color")).alias("l")
    )
    lists = (
        named.withColumn("_seen", seen)
        .withColumn("_problem", problem)
        .groupBy(*keys)
        .agg(
            F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("idx"))).alias("error"),
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["l"]).alias("_labels"),
        )
        .select(*keys, F.when(F.col("error").isNull(), F.col("_labels")).alias("labels"), "error")
    )
    refused = big.select(
        *keys,
        F.lit(None).cast("array<struct<value:string,label:string,color:string>>").alias("labels"),
        F.lit(f"A label set may hold at most {max_classes} labels").alias("error"),
    )
    return lists.unionByName(refused)
