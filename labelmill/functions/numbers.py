"""Number rules shared by every operator: half-up rounding on the double as computed."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up in doubles. ``F.round`` is half-away-from-zero on decimals, so 1.005 differs."""
    factor = float(10**digits)
    return F.floor(value.cast("double") * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def percent(part: Column, total: Column) -> Column:
    """One-decimal percentage, 0 for an empty total."""
    share = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    return F.coalesce(F.floor(share * 1000.0 + 0.5) / 10.0, F.lit(0.0))


def ratio(part: Column, total: Column, digits: int = 2) -> Column:
    """Rounded part/total, 0 for an empty total."""
    return F.coalesce(
        half_up(part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)), digits), F.lit(0.0)
    )


def plain_number(value: Column, digits: int = 6) -> Column:
    """Decimal text without trailing zeros or exponent: 0.2, 1, 0.00005."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value.cast("double")), r"\.?0+$", "")
