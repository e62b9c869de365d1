"""Label rules: default vocabularies, coercion, status, class slugs and colours."""

import sys
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The default label vocabularies and their "no label yet" members.
DEFAULT_SENTIMENTS = ("positive", "negative", "neutral", "unannotated")
DEFAULT_TYPES = ("bangla", "english", "banglish", "unclassified")
NO_SENTIMENT = "unannotated"
NO_TYPE = "unclassified"

# Statuses.
ANNOTATED = "annotated"
PENDING = "pending"


def derive_status(sentiment: Column, type_: Column) -> Column:
    """``annotated`` once both labels are set."""
    open_label = (sentiment == NO_SENTIMENT) | (type_ == NO_TYPE)
    return F.when(open_label, F.lit(PENDING)).otherwise(F.lit(ANNOTATED))


def coerce_label(value: Column, allowed: Iterable[str], fallback: str) -> Column:
    """Lower-case and trim; anything outside ``allowed`` becomes ``fallback``."""
    from labelmill.functions.text import trimmed

    cleaned = trimmed(F.lower(value))
    return F.when(cleaned.isin(list(allowed)), cleaned).otherwise(F.lit(fallback))


def label_color(index: Column) -> Column:
    """Evenly spaced hues by golden angle."""
    hue = F.pmod(index.cast("double") * 137.508, F.lit(360.0))
    return F.format_string("hsl(%d, 65%%, 55%%)", F.floor(hue + 0.5).cast("int"))


@F.pandas_udf(StringType())
def _strip_marks(names: pd.Series) -> pd.Series:
    def plain(name):
        if name is None:
            return None
        return "".join(
            ch for ch in unicodedata.normalize("NFKD", name.lower()) if not "\u0300" <= ch <= "\u036f"
        )

    return names.map(plain)


def class_slug(name: Column) -> Column:
    """``Café`` -> ``cafe``. Only label dimensions go through this Python function, never facts."""
    joined = F.regexp_replace(_strip_marks(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_")
    return F.btrim(joined, F.lit("_"))
