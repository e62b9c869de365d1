"""Bounding boxes as ``struct<x,y,width,height>`` in 0..1 coordinates, top-left origin."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.functions.numbers import half_up

BOX_TYPE = "struct<x:double,y:double,width:double,height:double>"

# Rejection reasons.
NOT_NUMERIC = "Box requires numeric x, y, width and height"
NOT_POSITIVE = "Box width and height must be greater than zero"
OFF_CANVAS = "Box must lie entirely within the 0..1 range"
OUTSIDE = "Box lies entirely outside the image"
NO_DIMENSIONS = "Pixel conversion requires positive image dimensions"
BAD_TIME = "timestampMs must be a numeric value in milliseconds"
NEGATIVE_TIME = "timestampMs must be zero or greater"
PAST_END = "Frame timestamp is beyond the end of the video"
BAD_FRAME = "frameIndex must be a numeric value"
NEGATIVE_FRAME = "frameIndex must be zero or greater"
FRACTIONAL_FRAME = "frameIndex must be a whole number"
FRAME_NEEDS_DURATION = "frameIndex needs a known video duration; send timestampMs instead"


def finite(*values: Column) -> Column:
    """True when no value is null, NaN or infinite: only finite doubles give 0 when multiplied by 0."""
    total = F.lit(0.0)
    for v in values:
        total = total + v.cast("double") * 0.0
    return F.coalesce(total == 0.0, F.lit(False))


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        width.cast("double").alias("width"),
        height.cast("double").alias("height"),
    )


def normalize_box(x: Column, y: Column, width: Column, height: Column, clamp: bool = True) -> Column:
    """``struct(box, reason)``: the stored box, or null with the reason it was refused.

    Clamping moves the corner onto the canvas and cuts the far edge; the given
    width is kept as given when the corner moved.
    """
    x, y, width, height = (c.cast("double") for c in (x, y, width, height))
    reason = F.when(~finite(x, y, width, height), NOT_NUMERIC).when(
        (width <= 0) | (height <= 0), NOT_POSITIVE
    )
    if clamp:
        left = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        top = F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
        w = F.least(width, 1.0 - left)
        h = F.least(height, 1.0 - top)
        # With a positive size, nothing is left exactly when the corner is past the far edge.
        reason = reason.when((x >= 1) | (y >= 1), OUTSIDE)
    else:
        left, top, w, h = x, y, width, height
        reason = reason.when((x < 0) | (y < 0) | (x + width > 1) | (y + height > 1), OFF_CANVAS)
    stored = box(half_up(left, 6), half_up(top, 6), half_up(w, 6), half_up(h, 6))
    return F.struct(
        F.when(reason.isNull(), stored).otherwise(F.lit(None).cast(BOX_TYPE)).alias("box"),
        reason.alias("reason"),
    )


def from_pixels(
    x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column
) -> Column:
    """A pixel box as ``struct(box, reason)``."""
    iw = F.when(image_width > 0, image_width.cast("double"))
    ih = F.when(image_height > 0, image_height.cast("double"))
    done = normalize_box(x / iw, y / ih, width / iw, height / ih)
    refused = F.struct(
        F.lit(None).cast(BOX_TYPE).alias("box"), F.lit(NO_DIMENSIONS).alias("reason")
    )
    return F.when(iw.isNull() | ih.isNull(), refused).otherwise(done)


def to_yolo(b: Column) -> Column:
    """Centre form ``struct(cx, cy, w, h)``."""
    return F.struct(
        half_up(b["x"] + b["width"] / 2, 6).alias("cx"),
        half_up(b["y"] + b["height"] / 2, 6).alias("cy"),
        half_up(b["width"], 6).alias("w"),
        half_up(b["height"], 6).alias("h"),
    )


def to_pixels(b: Column, image_width: Column, image_height: Column) -> Column:
    """Pixel box to two decimals; null without positive dimensions."""
    iw, ih = image_width.cast("double"), image_height.cast("double")
    px = box(
        half_up(b["x"] * iw, 2), half_up(b["y"] * ih, 2),
        half_up(b["width"] * iw, 2), half_up(b["height"] * ih, 2),
    )
    return F.when((iw > 0) & (ih > 0), px)


def box_area(b: Column) -> Column:
    return half_up(b["width"] * b["height"], 6)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; the union uses the rounded areas."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    shared = wide * high
    union = box_area(a) + box_area(b) - shared
    overlap = (wide > 0) & (high > 0) & (union > 0)
    return F.when(overlap, half_up(shared / F.when(union > 0, union), 6)).otherwise(F.lit(0.0))


def normalize_frame(frame_index: Column, timestamp_ms: Column, duration_ms: Column) -> Column:
    """``struct(frame_index, timestamp_ms, reason)`` for a video annotation."""
    ts, frame, duration = (c.cast("double") for c in (timestamp_ms, frame_index, duration_ms))
    known = finite(duration)
    reason = (
        F.when(ts.isNotNull() & ~finite(ts), BAD_TIME)
        .when(ts < 0, NEGATIVE_TIME)
        .when(known & (duration > 0) & (ts > duration), PAST_END)
        .when(frame.isNotNull() & ~finite(frame), BAD_FRAME)
        .when(frame < 0, NEGATIVE_FRAME)
        .when(frame != F.floor(frame), FRACTIONAL_FRAME)
        .when(frame.isNotNull() & ts.isNull() & ~known, FRAME_NEEDS_DURATION)
    )
    ok = reason.isNull()
    return F.struct(
        F.when(ok, frame).cast("bigint").alias("frame_index"),
        F.when(ok, F.floor(ts + 0.5)).cast("bigint").alias("timestamp_ms"),
        reason.alias("reason"),
    )
