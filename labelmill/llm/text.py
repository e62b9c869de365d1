"""Words and folds that several corpus operators share.

A word is a run of bytes other than space and the control characters 9 to 13, and lower case
folds A to Z alone. ``bytes.split`` and ``bytes.lower`` follow exactly these two rules, so tasks
work on UTF-8 bytes and agree with the SQL pattern.
"""

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def crc_fold(doc_id: int | None, parts: int) -> int:
    """``fold_of`` for one Python value."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def extended(schema: StructType, **fields: str) -> StructType:
    """A copy of ``schema`` with more fields, given as name=type."""
    return StructType([*schema.fields, *[StructField(n, DataType.fromDDL(t)) for n, t in fields.items()]])
