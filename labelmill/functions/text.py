"""Text column functions. All are built-in expressions, so they stay inside codegen."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Length bucket bounds.
LENGTH_BOUNDS = (0, 20, 50, 100, 200, 500, 1000, 100000)


def trimmed(text: Column) -> Column:
    """Strip Unicode white space (``F.trim`` alone strips only the space character)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def near_dup_key(text: Column, chars: int | None = None) -> Column:
    """Lower-cased, trimmed text, or its first ``chars`` characters; null when nothing is left."""
    folded = trimmed(F.lower(text))
    return F.nullif(folded if chars is None else F.substring(folded, 1, chars), F.lit(""))


def slug(value: Column) -> Column:
    """``Very Good!`` -> ``very_good``."""
    joined = F.regexp_replace(trimmed(F.lower(value)), "[^a-z0-9]+", "_")
    return F.btrim(joined, F.lit("_"))


def clip_preview(text: Column, chars: int = 200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def safe_base_name(name: Column) -> Column:
    """A file-name-safe form of a dataset name."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_")


def length_bucket(length: Column, bounds: Sequence[int] = LENGTH_BOUNDS) -> Column:
    """``struct(pos, label)``: ``0–19``, ``20–49`` … and ``last+`` for everything outside."""
    bounds = list(bounds)
    if len(bounds) < 2 or bounds != sorted(set(bounds)):
        raise ValueError("bounds must be at least two ascending numbers")
    overflow = F.struct(F.lit(len(bounds) - 1).alias("pos"), F.lit(f"{bounds[-1]}+").alias("label"))
    chain = F.when((length < bounds[0]) | (length >= bounds[-1]) | length.isNull(), overflow)
    for i, (start, end) in enumerate(zip(bounds, bounds[1:])):
        chain = chain.when(
            length < end, F.struct(F.lit(i).alias("pos"), F.lit(f"{start}–{end - 1}").alias("label"))
        )
    return chain.otherwise(overflow)


def iso_instant(ts: Column) -> Column:
    """``2026-02-01T00:00:00.000Z`` (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def csv_cell_plain(value: Column) -> Column:
    """Quote a cell holding a quote, comma or newline; null becomes empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def csv_cell_guarded(value: Column) -> Column:
    """As plain, also quoting ``\\r`` and defusing spreadsheet formulas with a leading quote mark."""
    raw = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(raw.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), raw)).otherwise(raw)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def csv_line(cells: Sequence[Column]) -> Column:
    return F.concat_ws(",", *cells)
