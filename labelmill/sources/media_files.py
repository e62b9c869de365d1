"""Catalogue of image and video files: kind, size, checksum, dimensions, duration.

A task opens each file, streams its checksum and reads the ranges that tell its size; no column holds a file's bytes.
Fixed-offset headers (PNG, GIF, BMP, WebP) are column expressions on the first bytes; formats whose size
sits behind a chain of segments or boxes (JPEG, TIFF, MP4) are walked in the task.
"""

import struct
import sys
from dataclasses import dataclass
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.sources.listing import Ranged, list_files, read_each, sha256_of
from labelmill.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Accepted extensions with MIME types.
IMAGE_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
}
VIDEO_TYPES = {
    "mp4": "video/mp4", "m4v": "video/x-m4v", "mov": "video/quicktime", "webm": "video/webm",
    "mkv": "video/x-matroska", "avi": "video/x-msvideo",
}
TIMED_VIDEO = ("mp4", "m4v", "mov")

# Enough for the headers at fixed places.
HEAD_BYTES = 64


@dataclass(frozen=True)
class Limits:
    """Files and images beyond a limit are refused with a reason; None is no limit."""

    max_bytes: int | None = None
    max_pixels: int | None = None


def _hex(content: Column, offset: int, count: int) -> Column:
    return F.hex(F.substring(content, offset + 1, count))


def _number(content: Column, offset: int, count: int, little: bool = False) -> Column:
    """Unsigned integer from ``count`` bytes."""
    if little:
        digits = F.concat(*[_hex(content, offset + i, 1) for i in reversed(range(count))])
    else:
        digits = _hex(content, offset, count)
    return F.conv(digits, 16, 10).cast("bigint")


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))


def header_size(content: Column) -> Column:
    """``struct(width, height)`` of PNG, GIF, BMP and WebP; null for anything else."""
    long_enough = F.length(content)
    png = (long_enough >= 24) & (_hex(content, 0, 4) == "89504E47") & (_hex(content, 12, 4) == "49484452")
    gif = (long_enough >= 10) & _hex(content, 0, 6).isin("474946383761", "474946383961")
    bmp = (long_enough >= 26) & (_hex(content, 0, 2) == "424D")
    webp = (long_enough >= 30) & (_hex(content, 0, 4) == "52494646") & (_hex(content, 8, 4) == "57454250")
    chunk = _hex(content, 12, 4)

    def unsigned_side(offset: int) -> Column:
        raw = _number(content, offset, 4, little=True)
        return F.abs(F.when(raw >= 2**31, raw - 2**32).otherwise(raw))

    low14 = F.lit(0x3FFF).cast("bigint")
    bits = _number(content, 21, 4, little=True)
    lossy = _size(
        _number(content, 26, 2, True).bitwiseAND(low14), _number(content, 28, 2, True).bitwiseAND(low14)
    )
    lossless = _size(
        bits.bitwiseAND(low14) + 1, F.shiftrightunsigned(bits, 14).bitwiseAND(low14) + 1
    )
    extended = _size(_number(content, 24, 3, True) + 1, _number(content, 27, 3, True) + 1)
    return (
        F.when(png, _size(_number(content, 16, 4), _number(content, 20, 4)))
        .when(gif, _size(_number(content, 6, 2, True), _number(content, 8, 2, True)))
        .when(bmp, _size(unsigned_side(18), unsigned_side(22)))
        .when(webp & (chunk == "56503820"), lossy)
        .when(webp & (chunk == "5650384C"), lossless)
        .when(webp & (chunk == "56503858"), extended)
    )


def _unpack(layout: str, data: Ranged, at: int) -> tuple:
    return struct.unpack(layout, data.part(at, struct.calcsize(layout)))


# JPEG markers without a length, and those that carry the frame size.
_JPEG_BARE = {0x01, *range(0xD0, 0xD9)}
_JPEG_FRAME = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def jpeg_size(data: Ranged):
    """(width, height) from the first frame header."""
    at, end = 2, len(data)
    while at + 9 < end:
        at = data.find(b"\xff", at)
        if at < 0 or at + 9 >= end:
            return None
        marker = data.part(at + 1, 1)[0]
        if marker == 0xFF:
            at += 1
        elif marker in _JPEG_BARE:
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        else:
            (length,) = _unpack(">H", data, at + 2)
            if marker in _JPEG_FRAME:
                height, width = _unpack(">HH", data, at + 5)
                return width, height
            at += 2 + length
    return None


def tiff_size(data: Ranged):
    """(width, height) from tags 256 and 257 of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data.part(0, 2))
    if order is None or len(data) < 8:
        return None
    (start,) = _unpack(order + "I", data, 4)
    if start + 2 > len(data):
        return None
    (entries,) = _unpack(order + "H", data, start)
    sides = {}
    for base in range(start + 2, min(start + 2 + 12 * entries, len(data) - 11), 12):
        tag, kind = _unpack(order + "HH", data, base)
        if tag in (256, 257) and kind in (3, 4):
            (sides[tag],) = _unpack(order + ("H" if kind == 3 else "I"), data, base + 8)
    return (sides[256], sides[257]) if sides.get(256) and sides.get(257) else None


def mp4_boxes(data: Ranged, start: int, end: int):
    """(type, body start, end) of the boxes in a byte range; stops at a malformed one."""
    while start + 8 <= end:
        size, kind = _unpack(">I4s", data, start)
        header = 8
        if size == 1 and start + 16 <= end:
            (size,) = _unpack(">Q", data, start + 8)
            header = 16
        elif size == 0:
            size = end - start
        if size < header or start + size > end:
            return
        yield kind, start + header, start + size
        start += size


def mp4_duration_ms(data: Ranged):
    """Duration from ``moov/mvhd``."""
    for kind, start, end in mp4_boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for inner, body, stop in mp4_boxes(data, start, end):
            if inner != b"mvhd":
                continue
            layout, need = (">IQ", 32) if data.part(body, 1) == b"\x01" else (">II", 20)
            if body + need > stop:
                return None
            scale, duration = _unpack(layout, data, body + (20 if layout == ">IQ" else 12))
            return int(duration / scale * 1000 + 0.5) if scale else None
    return None


def probe(file, row: dict) -> tuple:
    """SHA-256, first bytes, and the sides and duration of a file whose format must be walked."""
    data = Ranged(file, row["length"])
    head = data.part(0, min(HEAD_BYTES, len(data)))
    width = height = duration = None
    if row["extension"] in TIMED_VIDEO:
        duration = mp4_duration_ms(data)
    elif row["extension"] in IMAGE_TYPES:
        size = jpeg_size(data) if head[:2] == b"\xff\xd8" else tiff_size(data) if head[:2] in (b"II", b"MM") else None
        if size and size[0] > 0 and size[1] > 0:
            width, height = size
    return sha256_of(file), head, width, height, duration


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _extension() -> Column:
    return F.lower(F.regexp_extract(_name(), r"(?s)^.+\.([^.]*)$", 1))


def _problem(limits: Limits) -> Column:
    allowed = [*IMAGE_TYPES, *VIDEO_TYPES]
    listed = f"Allowed images: {', '.join(IMAGE_TYPES)}; allowed videos: {', '.join(VIDEO_TYPES)}"
    most = F.col("length") if limits.max_bytes is None else F.lit(limits.max_bytes)
    megabytes = round((limits.max_bytes or 0) / (1024 * 1024))
    return (
        F.when(F.col("length") == 0, F.lit("Uploaded file is empty"))
        .when(F.col("length") > most, F.lit(f"File exceeds the {megabytes} MB limit"))
        .when(F.col("extension") == "", F.concat(F.lit('"'), F.col("file_name"), F.lit('" has no file extension')))
        .when(
            ~F.col("extension").isin(allowed),
            F.concat(F.lit('Unsupported file type ".'), F.col("extension"), F.lit(f'". {listed}')),
        )
    )


@dataclass(frozen=True)
class Catalog:
    assets: DataFrame
    rejects: DataFrame


def media_catalog(
    spark: SparkSession, path: str, dataset_id: str, user: str, as_of: datetime,
    limits: Limits = Limits(),
) -> Catalog:
    """Files under ``path`` as pending assets, and the refused ones with the reason.

    Empty, oversize and unknown files are refused by what the listing tells, before they are opened. Byte copies
    within the dataset are left to ``checksum_duplicates``.
    """
    listed = list_files(spark, path).select("path", "length", _name().alias("file_name"), _extension().alias("extension"))
    listed = staged(listed.withColumn("reason", _problem(limits)), "media-listing")
    early = listed.where("reason is not null")
    fitting = listed.where("reason is null").drop("reason")
    read = read_each(
        fitting, probe, "checksum string, head binary, walked_width bigint, walked_height bigint, duration_ms bigint"
    )
    # Two tables read what the files told, and they are opened once.
    read = staged(read, "media-probed")
    image = F.col("extension").isin(list(IMAGE_TYPES))
    types = F.create_map(*[F.lit(v) for kv in {**IMAGE_TYPES, **VIDEO_TYPES}.items() for v in kv])
    now = F.lit(as_of).cast("timestamp")
    nobody = F.lit(None).cast("string")
    probed = read.select(
        "path", "file_name", "extension", F.col("length").alias("size_bytes"), "checksum", "duration_ms",
        F.when(image, "image").otherwise("video").alias("kind"), types[F.col("extension")].alias("mime_type"),
        F.when(image, header_size(F.col("head"))).alias("_fixed"), "walked_width", "walked_height",
    )
    probed = probed.withColumns(
        {"width": F.coalesce("walked_width", "_fixed.width"), "height": F.coalesce("walked_height", "_fixed.height")}
    ).drop("walked_width", "walked_height", "_fixed")
    real = (F.col("width") > 0) & (F.col("height") > 0)
    probed = probed.withColumns(
        {"width": F.when(real, F.col("width")), "height": F.when(real, F.col("height"))}
    )
    pixels = F.col("width") * F.col("height")
    too_many = F.lit(False) if limits.max_pixels is None else F.coalesce(pixels > limits.max_pixels, F.lit(False))
    assets = probed.where(~too_many).select(
        F.substring(F.sha2(F.concat_ws("\u0001", F.lit(dataset_id), F.col("path")), 256), 1, 24).alias("asset_id"),
        F.lit(dataset_id).alias("dataset_id"), "kind", "file_name",
        "extension", "mime_type", "size_bytes", "checksum", "width", "height", "duration_ms",
        F.col("path").alias("storage_path"), F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("annotation_count"), nobody.alias("assigned_to"),
        F.lit(None).cast("timestamp").alias("assigned_at"), nobody.alias("assigned_by"),
        F.lit("upload").alias("source"), F.lit(user).alias("created_by"), F.lit(user).alias("updated_by"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    large = probed.where(too_many).select(
        "path", "file_name",
        F.concat(
            F.lit("Image is "), size, F.lit(" ("), (F.col("width") * F.col("height")).cast("string"),
            F.lit(f" pixels), above the {limits.max_pixels} pixel limit"),
        ).alias("reason"),
    )
    return Catalog(assets, early.select("path", "file_name", "reason").unionByName(large))


def upload_report(stored: DataFrame, copies: DataFrame, rejects: DataFrame) -> DataFrame:
    """How many files were stored, were copies of stored ones, or were refused, by reason."""

    def counted(rows: DataFrame, outcome: str, reason: Column) -> DataFrame:
        return rows.groupBy(F.lit(outcome).alias("outcome"), reason.alias("reason")).agg(
            F.count("*").alias("files")
        )

    none = F.lit(None).cast("string")
    message = "This exact file is already in the dataset. Remove it first if you meant to replace it."
    return (
        counted(stored, "stored", none)
        .unionByName(counted(copies, "failed", F.lit(message)))
        .unionByName(counted(rejects, "failed", F.col("reason")))
    )
