"""Broadcasting dimensions only after measuring them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side up to this size (as JSON text, an upper bound for short columns) is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, measured by one scan without a shuffle, may be sent to every executor."""
    return df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0] <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows; otherwise as it is, left to AQE.

    Meant for vocabulary and dataset tables joined to facts: without the hint a
    derived dimension is often planned as a shuffle of the facts, which AQE can
    only undo after they have been written.
    """
    return F.broadcast(df) if is_small(df, limit) else df
