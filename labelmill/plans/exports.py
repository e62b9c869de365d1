"""Training exports of box annotations, for every dataset in one job."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions import geometry
from labelmill.functions.numbers import half_up, plain_number
from labelmill.operators.media import boxes_with_assets, exportable_assets
from labelmill.operators.numbering import number_rows
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

# Reasons for leaving something out of an export.
NO_BOXES = "no bounding boxes"
NO_SIZE = "unknown image dimensions"

_SORT = ["asset_created_at", "asset_id", "created_at", "annotation_id"]


@dataclass(frozen=True)
class Coco:
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame
    skipped: DataFrame


def _sized(width: str, height: str):
    return (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)


def _file_name():
    made = F.concat(F.col("asset_id"), F.lit("."), F.coalesce("extension", F.lit("")))
    return F.coalesce(F.nullif(F.col("file_name"), F.lit("")), made)


def _unknown_label():
    return F.concat(F.lit('unknown label "'), F.col("label"), F.lit('"'))


def _labelled(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    known = classes.select("dataset_id", F.col("value").alias("label"), "class_id")
    return boxes.join(broadcast_if_small(known), ["dataset_id", "label"], "left")


def _with_box_summary(assets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Assets with the number of their boxes and the first box's frame, folded before the join."""
    boxes = annotations.where(F.col("kind") == "bbox")
    summary = boxes.groupBy("asset_id").agg(
        F.count("*").alias("boxes"),
        F.min_by("frame_index", F.struct("created_at", "annotation_id")).alias("first_frame"),
    )
    return assets.join(summary, "asset_id", "left")


def _has_boxes():
    return F.col("boxes").isNotNull()


def coco_images(chosen: DataFrame, annotations: DataFrame) -> DataFrame:
    """Assets with a box and a known size."""
    return _images(_with_box_summary(chosen, annotations))


def _images(counted: DataFrame) -> DataFrame:
    return counted.where(_has_boxes() & _sized("width", "height")).select(
        "dataset_id", F.col("asset_id").alias("id"), _file_name().alias("file_name"), "width", "height",
        F.when(F.col("kind") == "video", F.col("first_frame")).alias("frame_index"), "created_at",
    )


def coco_annotations(chosen: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes in pixels, numbered from 1 within a dataset in asset then box order."""
    return _numbered_boxes(_labelled(boxes_with_assets(chosen, annotations), classes))


def _numbered_boxes(boxes: DataFrame) -> DataFrame:
    kept = boxes.where(F.col("class_id").isNotNull() & _sized("asset_width", "asset_height"))
    px = geometry.to_pixels(F.col("box"), F.col("asset_width"), F.col("asset_height"))
    numbered = number_rows(
        kept.select("dataset_id", *_SORT, "class_id", "frame_index", "timestamp_ms", px.alias("px")),
        ["dataset_id"], _SORT, "id",
    )
    return numbered.select(
        "dataset_id", "id", F.col("asset_id").alias("image_id"), F.col("class_id").alias("category_id"),
        F.array("px.x", "px.y", "px.width", "px.height").alias("bbox"),
        half_up(F.col("px.width") * F.col("px.height"), 2).alias("area"),
        F.lit(0).alias("iscrowd"), "frame_index", "timestamp_ms",
    )


def coco_categories(classes: DataFrame) -> DataFrame:
    return classes.select(
        "dataset_id", F.col("class_id").alias("id"), F.col("value").alias("name"),
        F.lit("object").alias("supercategory"),
    )


def coco_skipped(chosen: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Assets left out, and boxes of exported assets whose label is no class."""
    return _left_out(_with_box_summary(chosen, annotations), _labelled(boxes_with_assets(chosen, annotations), classes))


def _left_out(counted: DataFrame, boxes: DataFrame) -> DataFrame:
    reason = F.when(~_has_boxes(), NO_BOXES).otherwise(NO_SIZE)
    unknown = boxes.where(F.col("class_id").isNull() & _sized("asset_width", "asset_height"))
    return (
        counted.where(~_has_boxes() | ~_sized("width", "height"))
        .select("dataset_id", "asset_id", reason.alias("reason"))
        .unionByName(unknown.select("dataset_id", "asset_id", _unknown_label().alias("reason")))
    )


def to_coco(
    assets: DataFrame, annotations: DataFrame, classes: DataFrame,
    include_unannotated: bool = False, kind: str | None = None,
) -> Coco:
    """The four COCO tables of every dataset. Assets meet their boxes once for all of them."""
    chosen = exportable_assets(assets, include_unannotated, kind)
    counted = staged(_with_box_summary(chosen, annotations), "counted-assets")
    boxes = staged(_labelled(boxes_with_assets(chosen, annotations), classes), "labelled-boxes")
    return Coco(_images(counted), _numbered_boxes(boxes), coco_categories(classes), _left_out(counted, boxes))


@dataclass(frozen=True)
class Yolo:
    lines: DataFrame
    classes: DataFrame
    skipped: DataFrame
    image_counts: DataFrame


def to_yolo(
    assets: DataFrame, annotations: DataFrame, classes: DataFrame,
    include_unannotated: bool = False, kind: str | None = None,
) -> Yolo:
    """YOLO label lines with the file each belongs to; dimensions are not needed."""
    chosen = exportable_assets(assets, include_unannotated, kind)
    boxes = _labelled(boxes_with_assets(chosen, annotations), classes)
    centre = geometry.to_yolo(F.col("box"))
    line = F.concat_ws(
        " ", F.col("class_id").cast("string"), *[plain_number(centre[c]) for c in ("cx", "cy", "w", "h")]
    )
    suffix = F.when(
        F.col("frame_index").isNotNull(),
        F.concat(F.lit("_f"), F.lpad(F.col("frame_index").cast("string"), 6, "0")),
    )
    # lpad cuts longer numbers; frames past 999999 keep all digits.
    suffix = F.when(
        F.col("frame_index") > 999_999, F.concat(F.lit("_f"), F.col("frame_index").cast("string"))
    ).otherwise(suffix)
    known = boxes.where(F.col("class_id").isNotNull())
    lines = known.select(
        "dataset_id", "asset_id", "frame_index", "created_at", "annotation_id",
        F.concat(F.lit("labels/"), F.col("asset_id"), F.coalesce(suffix, F.lit("")), F.lit(".txt")).alias("file"),
        line.alias("line"),
    )
    skipped = (
        _with_box_summary(chosen, annotations)
        .where(F.col("boxes").isNull())
        .select("dataset_id", "asset_id", F.lit(NO_BOXES).alias("reason"))
        .unionByName(
            boxes.where(F.col("class_id").isNull()).select(
                "dataset_id", "asset_id", _unknown_label().alias("reason")
            )
        )
    )
    counts = known.groupBy("dataset_id", "asset_id").agg(F.count("*").alias("_n"))
    counts = counts.groupBy("dataset_id").agg(F.count("*").alias("image_count"))
    return Yolo(lines, classes, skipped, counts)


def to_boxes_table(
    assets: DataFrame, annotations: DataFrame, classes: DataFrame,
    include_unannotated: bool = False, kind: str | None = None,
) -> DataFrame:
    """One row per exportable box; boxes of unknown label or asset size are left out."""
    chosen = exportable_assets(assets, include_unannotated, kind)
    boxes = _labelled(boxes_with_assets(chosen, annotations), classes)
    px = geometry.to_pixels(F.col("box"), F.col("asset_width"), F.col("asset_height"))
    kept = boxes.where(F.col("class_id").isNotNull() & _sized("asset_width", "asset_height"))
    return kept.withColumn("px", px).select(
        "dataset_id", "asset_id", _file_name().alias("file_name"), "asset_width", "asset_height", "label",
        "class_id", "px.x", "px.y", "px.width", "px.height", "frame_index", "timestamp_ms",
        "asset_created_at", "created_at", "annotation_id",
    )


def ml_rows(split: DataFrame, datasets: DataFrame) -> DataFrame:
    """Split comments in the seven columns of the text training export."""
    names = datasets.select("dataset_id", "name", "taxonomy_name")
    return split.join(names, "dataset_id", "left").select(
        "dataset_id", "comment_id", F.col("source_id").alias("id"), "text", "sentiment", "type", "split",
        F.col("name").alias("dataset"), F.coalesce("taxonomy_name", F.lit("Default")).alias("taxonomy"),
    )
