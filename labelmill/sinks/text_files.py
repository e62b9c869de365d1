"""Text exports. Parts sort after one another: ``cat part-*`` gives the whole file.

Rows are range-partitioned on their order, so every task writes a share
whatever the size of one dataset.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import csv_cell_guarded, csv_cell_plain, csv_line, iso_instant

# The column order of each export.
ML_COLUMNS = ("id", "text", "sentiment", "type", "split", "dataset", "taxonomy")
COMMENT_COLUMNS = ("id", "comment_text", "sentiment", "type", "status", "version", "annotatedAt")
BOX_COLUMNS = (
    "asset_id", "file_name", "asset_width", "asset_height", "label", "class_id",
    "x", "y", "width", "height", "frame_index", "timestamp_ms",
)
BYTE_ORDER_MARK = "\ufeff"


def _write_lines(lines: DataFrame, order: Sequence[str], path: str, line_end: str) -> None:
    """Lines with dataset_id, one directory per dataset."""
    ordered = lines.repartitionByRange("dataset_id", *order).sortWithinPartitions("dataset_id", *order)
    ordered.select("dataset_id", "value").write.partitionBy("dataset_id").option(
        "lineSep", line_end
    ).text(path)


def _with_header(rows: DataFrame, header: str, order: Sequence[str]) -> DataFrame:
    """Add the header as each dataset's first line."""
    heads = rows.select("dataset_id").distinct()
    heads = heads.select(
        "dataset_id", F.lit(0).alias("_row"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order],
        F.lit(header).alias("value"),
    )
    return heads.unionByName(rows.withColumn("_row", F.lit(1)))


def ml_json(rows: DataFrame) -> DataFrame:
    """``value``: one JSON object per row, keys in export order, nulls kept."""
    line = F.to_json(F.struct(*ML_COLUMNS), {"ignoreNullFields": "false"})
    return rows.select("dataset_id", "comment_id", line.alias("value"))


def write_ml_jsonl(rows: DataFrame, path: str) -> None:
    _write_lines(ml_json(rows), ["comment_id"], path, "\n")


def ml_csv_lines(rows: DataFrame) -> DataFrame:
    line = csv_line([csv_cell_guarded(F.col(c)) for c in ML_COLUMNS])
    return rows.select("dataset_id", "comment_id", line.alias("value"))


def write_ml_csv(rows: DataFrame, path: str, mark: bool = True) -> None:
    header = (BYTE_ORDER_MARK if mark else "") + ",".join(ML_COLUMNS)
    lines = _with_header(ml_csv_lines(rows), header, ["comment_id"])
    _write_lines(lines, ["_row", "comment_id"], path, "\r\n")


def comment_csv_lines(comments: DataFrame) -> DataFrame:
    cells: list[Column] = [
        F.col("source_id"), F.col("text"), F.col("sentiment"), F.col("type"), F.col("status"),
        F.col("version"), iso_instant(F.col("annotated_at")),
    ]
    line = csv_line([csv_cell_guarded(c) for c in cells])
    return comments.select("dataset_id", "created_at", "comment_id", line.alias("value"))


def write_comments_csv(comments: DataFrame, path: str, mark: bool = True) -> None:
    """Comments (filter them first) in creation order."""
    header = (BYTE_ORDER_MARK if mark else "") + ",".join(COMMENT_COLUMNS)
    order = ["created_at", "comment_id"]
    lines = _with_header(comment_csv_lines(comments), header, order)
    _write_lines(lines, ["_row", *order], path, "\r\n")


def box_csv_lines(boxes: DataFrame) -> DataFrame:
    numbers = {"x", "y", "width", "height"}

    def cell(name: str) -> Column:
        from labelmill.functions.numbers import plain_number

        return csv_cell_plain(plain_number(F.col(name), 2) if name in numbers else F.col(name))

    return boxes.select(
        "dataset_id", "asset_created_at", "asset_id", "created_at", "annotation_id",
        csv_line([cell(c) for c in BOX_COLUMNS]).alias("value"),
    )


def write_boxes_csv(boxes: DataFrame, path: str) -> None:
    order = ["asset_created_at", "asset_id", "created_at", "annotation_id"]
    lines = _with_header(box_csv_lines(boxes), ",".join(BOX_COLUMNS), order)
    _write_lines(lines, ["_row", *order], path, "\n")
