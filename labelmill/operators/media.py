"""Media assets and box annotations: counts, derived state, joins for export, overlaps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import geometry
from labelmill.functions.numbers import half_up, ratio
from labelmill.operators.quality import class_balance
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

# Boxes below this area have areas that round coarsely; their overlaps are found by a plain grid.
SMALL_AREA = 1e-4
SMALL_GRID = 0.01

# Up to so many different boxes of one asset and frame are compared directly.
PLAIN_BOXES = 500
# Boxes of a cell that one task compares with one another.
CELL_BOXES = 2000
# Halvings of a small cell's side.
MOST_DEPTH = 24
_NO_CLASS = 1_000_000


def annotation_box() -> Column:
    return geometry.box(F.col("x"), F.col("y"), F.col("box_width"), F.col("box_height"))


def label_histogram(annotations: DataFrame) -> DataFrame:
    """Boxes per dataset and label, most frequent first."""
    boxes = annotations.where(F.col("kind") == "bbox")
    counts = boxes.groupBy("dataset_id", "label").agg(F.count("*").alias("count"))
    return counts.orderBy("dataset_id", F.col("count").desc(), "label")


def label_counts(annotations: DataFrame) -> DataFrame:
    """Annotations of every kind per dataset and label, unlabelled ones as ``(none)``."""
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("(none)"))
    return annotations.groupBy("dataset_id", label.alias("label")).agg(F.count("*").alias("count"))


def distinct_labels(annotations: DataFrame) -> DataFrame:
    kept = annotations.where(F.col("label").isNotNull())
    return kept.select("dataset_id", "label").distinct().orderBy("dataset_id", "label")


def asset_counts(assets: DataFrame) -> DataFrame:
    """Assets per dataset by status and kind, and their bytes."""
    return assets.groupBy("dataset_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "annotated").alias("annotated"),
        F.count_if(F.col("kind") == "image").alias("image"),
        F.count_if(F.col("kind") == "video").alias("video"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"),
    )


def refresh_asset_state(assets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Recompute ``annotation_count`` and ``status``; counts fold before the join."""
    counts = annotations.groupBy("asset_id").agg(F.count("*").alias("_n"))
    number = F.coalesce("_n", F.lit(0))
    return (
        assets.drop("annotation_count", "status")
        .join(counts, "asset_id", "left")
        .withColumns(
            {
                "annotation_count": number,
                "status": F.when(number > 0, "annotated").otherwise("pending"),
            }
        )
        .drop("_n")
    )


def refresh_dataset_counters(
    media_datasets: DataFrame, assets: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Recompute the counters carried on each media dataset."""
    per_asset = assets.groupBy("dataset_id").agg(
        F.count("*").alias("_assets"),
        F.count_if(F.col("status") == "annotated").alias("_annotated"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("_bytes"),
    )
    per_box = annotations.groupBy("dataset_id").agg(F.count("*").alias("_boxes"))
    counters = {
        "total_assets": "_assets", "annotated_assets": "_annotated",
        "total_annotations": "_boxes", "total_bytes": "_bytes",
    }
    joined = (
        media_datasets.drop(*counters)
        .join(per_asset, "dataset_id", "left")
        .join(per_box, "dataset_id", "left")
        .withColumns({new: F.coalesce(old, F.lit(0)) for new, old in counters.items()})
        .drop(*counters.values())
    )
    return joined.withColumn(
        "annotated_ratio", ratio(F.col("annotated_assets"), F.col("total_assets"))
    )


def dataset_stats(media_datasets: DataFrame, assets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per dataset: assets by status and kind, boxes and class balance."""
    boxes = annotations.where(F.col("kind") == "bbox")
    histogram = boxes.groupBy("dataset_id", "label").agg(F.count("*").alias("count"))
    joined = (
        media_datasets.select("dataset_id")
        .join(asset_counts(assets), "dataset_id", "left")
        .join(class_balance(histogram, ["dataset_id"]), "dataset_id", "left")
    )
    zero = [c for c in joined.columns if c not in ("dataset_id", "class_balance")]
    return joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in zero},
            "class_balance": F.coalesce("class_balance", F.lit(0.0)),
        }
    )


def checksum_duplicates(assets: DataFrame) -> DataFrame:
    """Assets holding bytes another, earlier asset of the dataset already holds.

    An asset without a checksum is no copy. The keeper is a map-side minimum and rows drop out by
    asset id, so one file copied a million times spreads evenly.
    """
    assets = assets.where(F.col("checksum").isNotNull())
    keepers = assets.groupBy("dataset_id", "checksum").agg(
        F.min(F.struct("created_at", "asset_id")).alias("_first")
    )
    return assets.join(keepers.select(F.col("_first.asset_id").alias("asset_id")), "asset_id", "left_anti")


def exportable_assets(
    assets: DataFrame, include_unannotated: bool = False, kind: str | None = None,
    annotations: DataFrame | None = None,
) -> DataFrame:
    """Assets with annotations, by their counter, or by ``annotations`` when counters are stale."""
    kept = assets.where(F.col("kind") == kind) if kind else assets
    if include_unannotated:
        return kept
    if annotations is not None:
        return kept.join(annotations.select("asset_id"), "asset_id", "left_semi")
    return kept.where(F.col("annotation_count") > 0)


def boxes_with_assets(assets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each box with its asset's name, size, kind and time."""
    side = assets.select(
        "asset_id", F.col("kind").alias("asset_kind"), "file_name", "extension",
        F.col("width").alias("asset_width"), F.col("height").alias("asset_height"),
        F.col("created_at").alias("asset_created_at"),
    )
    boxes = annotations.where(F.col("kind") == "bbox").select(
        "annotation_id", "asset_id", "dataset_id", "label", annotation_box().alias("box"),
        "frame_index", "timestamp_ms", "created_at",
    )
    return boxes.join(side, "asset_id")


def recent_work(annotations: DataFrame, assets: DataFrame, user_id: str, n: int = 10) -> DataFrame:
    """A user's newest ``n`` annotations with the asset's name."""
    if n < 1:
        raise ValueError("n must be at least 1")
    newest = (
        annotations.where(F.col("created_by") == user_id)
        .orderBy(F.col("created_at").desc(), "annotation_id")
        .limit(n)
    )
    return newest.join(assets.select("asset_id", "file_name"), "asset_id", "left")


def recent_work_by_user(annotations: DataFrame, n: int = 15) -> DataFrame:
    """Every user's newest ``n`` annotations; the rank limit applies before the shuffle."""
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy("created_by").orderBy(F.col("created_at").desc(), "annotation_id")
    return annotations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _distinct_boxes(annotations: DataFrame) -> DataFrame:
    """Boxes that differ, with their copies; ``small`` is aggregated so every use shares one shuffle."""
    place = ["asset_id", "frame", "x", "y", "box_width", "box_height"]
    boxes = annotations.where((F.col("kind") == "bbox") & (F.col("box_width") > 0) & (F.col("box_height") > 0))
    boxes = boxes.withColumn("frame", F.coalesce("frame_index", F.lit(-1)).cast("bigint"))
    return boxes.groupBy(*place).agg(
        F.count("*").alias("copies"),
        F.min("annotation_id").alias("annotation_id"),
        F.max(F.col("box_width") * F.col("box_height") < SMALL_AREA).alias("small"),
    )


def _size_cells(boxes: DataFrame, bound: float, spread: bool) -> DataFrame:
    """Add kx, gx, ky, gy: the size classes a partner may share and the cells it may start in.

    Cells of a class are as long as its longest side, so a corner within reach
    is in one of three neighbouring cells.
    """
    step = F.lit(1.0 / bound)
    reach = F.lit(1.0 - bound if spread else 0.0)
    steps = range(3) if spread else range(1)
    offsets = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(("kx", "ky", "gx", "gy"), (kx, ky, gx, gy))])
            for kx in range(2) for ky in range(2) for gx in steps for gy in steps
        ]
    )
    out = boxes.withColumn("o", F.explode(offsets))
    for axis, corner, own in (("x", "x", "cw"), ("y", "y", "ch")):
        out = out.withColumn(f"k{axis}", F.col(own) + F.col(f"o.k{axis}"))
        at = F.col(corner) / F.pow(step, F.col(f"k{axis}") + 1)
        out = out.withColumn(f"g{axis}", F.floor(at - reach) + F.col(f"o.g{axis}"))
        out = out.where(F.col(f"g{axis}") <= F.floor(at + reach))
    return out.drop("o")


def _covered(rows: DataFrame, side: Column) -> DataFrame:
    """A row for every cell (gx, gy) of a plain grid that a box covers."""

    def cells(corner: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(corner) / side), F.floor(F.col(end) / side)))

    return rows.withColumn("gx", cells("x", "right")).withColumn("gy", cells("y", "bottom"))


def _small_cells(boxes: DataFrame, most: int) -> DataFrame:
    """Small boxes by the cells they cover: a plain grid whose crowded cells are split in four, and again.

    Counts are measured at every depth. A cell with more than ``most`` boxes is split if its quarters hold half as many on
    average; boxes that all cover the same place cannot be told apart by cells. ``ky`` is the depth.
    """
    none = F.lit(_NO_CLASS).cast("bigint")
    rows = _covered(boxes.where("small").withColumns({"kx": none, "ky": F.lit(0).cast("bigint")}), F.lit(SMALL_GRID))
    cell, out = ["asset_id", "frame", "gx", "gy"], None
    for depth in range(MOST_DEPTH):
        rows = staged(rows, "small-cells")
        half = F.lit(SMALL_GRID / 2 ** (depth + 1))

        def crossed(corner: str, end: str, at: str) -> Column:
            """How many halves of its cell a box covers."""
            first = F.greatest(F.floor(F.col(corner) / half), 2 * F.col(at))
            return F.least(F.floor(F.col(end) / half), 2 * F.col(at) + 1) - first + 1

        quarters = crossed("x", "right", "gx") * crossed("y", "bottom", "gy")
        crowded = rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum(quarters).alias("_quarters"))
        crowded = staged(crowded.where((F.col("_n") > most) & (F.col("_quarters") <= 2 * F.col("_n"))).select(*cell), "crowded-cells")
        if crowded.isEmpty():
            return rows if out is None else out.unionByName(rows)
        side = broadcast_if_small(crowded)
        done = rows.join(side, cell, "left_anti")
        out = done if out is None else out.unionByName(done.select(*out.columns))
        split = rows.join(side, cell, "left_semi").withColumns({"_px": F.col("gx"), "_py": F.col("gy")})
        split = _covered(split.drop("gx", "gy"), half).where((F.floor(F.col("gx") / 2) == F.col("_px")) & (F.floor(F.col("gy") / 2) == F.col("_py")))
        rows = split.drop("_px", "_py").withColumn("ky", F.lit(depth + 1).cast("bigint")).select(*out.columns)
    return out.unionByName(rows)


def _in_blocks(left: DataFrame, right: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block``: a cell's rows are dealt to blocks of about ``most`` by ``most`` rows, so that a cell that
    cannot be split is worked on by many tasks. A row goes to all blocks of its own part."""
    sizes = [rows.groupBy("cell").agg(F.count("*").alias(f"_{tag}")) for tag, rows in (("a", left), ("b", right))]
    parts = [F.ceil(F.col(f"_{tag}") / most).cast("int") for tag in "ab"]
    crowded = sizes[0].join(sizes[1], "cell").where((F.col("_a") > most) | (F.col("_b") > most))
    crowded = staged(crowded.select(F.col("cell").alias("_cell"), parts[0].alias("_pa"), parts[1].alias("_pb")), "cell-parts")
    if crowded.isEmpty():
        return tuple(rows.withColumn("block", F.lit(0)) for rows in (left, right))
    crowded = broadcast_if_small(crowded)

    def dealt(rows: DataFrame, tag: str, own: str, other: str) -> DataFrame:
        joined = rows.join(crowded, F.col("cell") == F.col("_cell"), "left")
        part = F.pmod(F.xxhash64(f"{tag}_annotation_id"), F.col(own)).cast("int")
        each = F.sequence(F.lit(0), F.col(other) - 1)
        blocks = F.transform(each, lambda o: (part * F.col("_pb") + o) if tag == "a" else (o * F.col("_pb") + part))
        blocks = F.when(F.col("_cell").isNull(), F.array(F.lit(0))).otherwise(blocks)
        return joined.withColumn("block", F.explode(blocks)).drop("_cell", "_pa", "_pb")

    return dealt(left, "a", "_pa", "_pb"), dealt(right, "b", "_pb", "_pa")


def _direct_pairs(boxes: DataFrame) -> DataFrame:
    """Each two boxes of one asset and frame that touch, as a_ and b_ columns."""
    names = ["asset_id", "frame", "x", "y", "right", "bottom", "area", "annotation_id", "copies"]
    a, b = (boxes.select(*[F.col(c).alias(f"{tag}_{c}") for c in names]) for tag in "ab")
    return a.join(
        b,
        (F.col("a_asset_id") == F.col("b_asset_id")) & (F.col("a_frame") == F.col("b_frame"))
        & (F.col("a_annotation_id") < F.col("b_annotation_id"))
        & (F.col("a_x") < F.col("b_right")) & (F.col("b_x") < F.col("a_right"))
        & (F.col("a_y") < F.col("b_bottom")) & (F.col("b_y") < F.col("a_bottom")),
    )


def _grid_pairs(boxes: DataFrame, bound: float, most: int) -> DataFrame:
    """Boxes of crowded frames that meet by size class and cell, as a_ and b_ columns."""
    cell = ["asset_id", "frame", "kx", "ky", "gx", "gy"]
    plain = ["x", "y", "right", "bottom", "area", "annotation_id", "copies", "small", "cw", "ch"]

    # One hash is cheaper to shuffle and sort on than six keys; equal keys are checked after.
    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(
            F.xxhash64(*cell).alias("cell"), *[F.col(c).alias(f"{tag}_{c}") for c in (*cell, *plain)]
        )

    left, right = _size_cells(boxes, bound, True), _size_cells(boxes, bound, False)
    if not boxes.where("small").isEmpty():
        small = _small_cells(boxes, most)
        left, right = left.unionByName(small), right.unionByName(small)
    left, right = _in_blocks(staged(side(left, "a"), "left-cells"), staged(side(right, "b"), "right-cells"), most)
    met = left.join(right, ["cell", "block"])
    met = met.where(F.col("a_annotation_id") < F.col("b_annotation_id"))
    for c in cell:
        met = met.where(F.col(f"a_{c}") == F.col(f"b_{c}"))
    sized = (
        (F.greatest("a_cw", "b_cw") == F.col("a_kx"))
        & (F.greatest("a_ch", "b_ch") == F.col("a_ky"))
        & ~(F.col("a_small") & F.col("b_small"))
    )
    # Both boxes cover the cell that their overlap begins in, and no other cell of the tree holds that point.
    length = F.lit(SMALL_GRID) / F.pow(F.lit(2.0), F.col("a_ky"))
    cornered = (
        (F.col("a_kx") == _NO_CLASS)
        & (F.floor(F.greatest("a_x", "b_x") / length) == F.col("a_gx"))
        & (F.floor(F.greatest("a_y", "b_y") / length) == F.col("a_gy"))
    )
    return met.where(sized | cornered)


def overlap_pairs(
    annotations: DataFrame, min_iou: float, plain_boxes: int = PLAIN_BOXES, cell_boxes: int = CELL_BOXES
) -> DataFrame:
    """Pairs of boxes of one asset and frame with IoU of at least ``min_iou``.

    Equal boxes fold into one with a copy count, so a pair row stands for
    ``pairs`` = copies_a * copies_b annotation pairs, and a row pairing a box
    with itself for the pairs among its copies. The boxes of an ordinary frame
    are compared directly; those of a crowded one meet only when sizes and
    places allow the IoU: sides within the factor 1/min_iou and corners within
    (1 - min_iou) of the longer side, which a size class and a grid cell
    express as equality keys. Every qualifying pair meets in exactly one cell. Cells with more than ``cell_boxes``
    boxes are split where that tells boxes apart, and worked on in blocks where it does not.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be above 0 and at most 1")
    # Area rounding can lift an IoU a little, so classes and reach are a little wider than min_iou asks.
    bound = 0.98 * min_iou
    log_step = F.log(F.lit(1.0 / bound))
    # Both join sides and the copies read the folded boxes, so they are written once.
    folded = _distinct_boxes(annotations).withColumns(
        {
            "right": F.col("x") + F.col("box_width"), "bottom": F.col("y") + F.col("box_height"),
            "area": geometry.box_area(annotation_box()),
            "cw": F.floor(F.log("box_width") / log_step), "ch": F.floor(F.log("box_height") / log_step),
        }
    )
    boxes = staged(folded, "boxes")
    frame = ["asset_id", "frame"]
    crowded = boxes.groupBy(*frame).agg(F.count("*").alias("_n")).where(F.col("_n") > plain_boxes).select(*frame)
    crowded = staged(crowded, "crowded-frames")
    met = _direct_pairs(boxes.join(crowded, frame, "left_anti"))
    if not crowded.isEmpty():
        many = staged(boxes.join(crowded, frame, "left_semi"), "crowded-boxes")
        met = met.unionByName(_grid_pairs(many, bound, cell_boxes).select(*met.columns))
    wide = F.least("a_right", "b_right") - F.greatest("a_x", "b_x")
    high = F.least("a_bottom", "b_bottom") - F.greatest("a_y", "b_y")
    met = met.where((wide > 0) & (high > 0))

    # The overlap is exploded as a one-element array: a filter on it stays above the join, so it
    # is computed once per candidate and the join's generated code stays small enough to compile well.
    met = met.select(
        F.col("a_asset_id").alias("asset_id"), F.col("a_frame").alias("frame"),
        F.col("a_annotation_id").alias("first_id"), F.col("b_annotation_id").alias("second_id"),
        (F.col("a_copies") * F.col("b_copies")).alias("pairs"),
        (F.col("a_area") + F.col("b_area")).alias("areas"), F.explode(F.array(wide * high)).alias("shared"),
    )
    copies = boxes.where(F.col("copies") > 1).select(
        "asset_id", "frame", F.col("annotation_id").alias("first_id"),
        F.col("annotation_id").alias("second_id"),
        F.floor(F.col("copies") * (F.col("copies") - 1) / 2).alias("pairs"),
        (F.col("area") * 2).alias("areas"),
        ((F.col("right") - F.col("x")) * (F.col("bottom") - F.col("y"))).alias("shared"),
    )
    union = F.col("areas") - F.col("shared")
    share = F.col("shared") / F.when(union > 0, union)
    kept = met.unionByName(copies).withColumn("iou", F.coalesce(half_up(share, 6), F.lit(0.0)))
    return kept.where(F.col("iou") >= min_iou).select(
        "asset_id", F.nullif("frame", F.lit(-1).cast("bigint")).alias("frame_index"),
        "first_id", "second_id", "iou", "pairs",
    )
