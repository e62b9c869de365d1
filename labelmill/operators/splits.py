"""Reproducible train/val/test splits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.labels import ANNOTATED
from labelmill.operators.numbering import number_rows
from labelmill.operators.sizes import broadcast_if_small


def split_dataset(
    comments: DataFrame, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)
) -> DataFrame:
    """Annotated comments with ``split``: by id order, the first share train, the next val, the rest test.

    Only ids are numbered and sorted. What the texts need is two border ids
    per dataset, so they are never shuffled.
    """
    train, val, test = (float(f) for f in fractions)
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("split must be three numbers summing to 1 (e.g. 0.8,0.1,0.1)")
    labelled = comments.where(F.col("status") == ANNOTATED)
    numbered = number_rows(labelled.select("dataset_id", "comment_id"), ["dataset_id"], ["comment_id"], "_n")
    sizes = numbered.groupBy("dataset_id").agg(F.max("_n").alias("_size"))
    n_train = F.floor(F.col("_size") * F.lit(train))
    n_val = F.floor(F.col("_size") * F.lit(val))
    borders = (
        numbered.join(sizes, "dataset_id")
        .where((F.col("_n") == n_train) | (F.col("_n") == n_train + n_val))
        .groupBy("dataset_id")
        .agg(
            F.max(F.when(F.col("_n") == n_train, F.col("comment_id"))).alias("_train_end"),
            F.max(F.when(F.col("_n") == n_train + n_val, F.col("comment_id"))).alias("_val_end"),
        )
    )
    split = (
        F.when(F.col("comment_id") <= F.col("_train_end"), "train")
        .when(F.col("comment_id") <= F.col("_val_end"), "val")
        .otherwise("test")
    )
    return labelled.join(broadcast_if_small(borders), "dataset_id", "left").withColumn("split", split).drop("_train_end", "_val_end")
