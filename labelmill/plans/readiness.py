"""Training-readiness score and warnings, as expressions over one summary row per dataset.

Input columns: total, annotated, duplicate_count, and for each axis ``s_``
(sentiment) and ``t_`` (type): classes, balance_score, imbalance_ratio, top, bottom.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.functions.numbers import half_up, plain_number

# Levels by score, and per rule its bound, penalty and message.
LEVELS = ((80, "ready"), (55, "close"), (30, "needs_work"))
COVERAGE = (
    (50, 40, "Only %s%% of comments are annotated (need ≥ 50%% to even consider training)."),
    (90, 15, "%s%% annotated — finish the rest for a cleaner split."),
)
SIZE = (
    (100, 20, "Only %s comments — most text models need at least a few hundred."),
    (500, 8, "%s comments — workable for prototyping, thin for production."),
)
SENTIMENT_CLASSES = (2, 30, "Sentiment has fewer than 2 classes — nothing to classify.")
SENTIMENT_BALANCE = (
    (0.5, 20, "Sentiment classes are very imbalanced (balance score %s). Consider collecting more of the minority class."),
    (0.75, 8, "Sentiment classes are moderately imbalanced (balance score %s)."),
)
TYPE_CLASSES = (2, 15, "Type/Language has fewer than 2 classes.")
TYPE_BALANCE = ((0.5, 10, "Type/Language classes are imbalanced (balance score %s)."),)
COPIES = (
    (10, 10, "%s near-duplicate comments (%s%%) — dedupe before training."),
    (3, 4, "%s near-duplicate comments detected."),
)
NO_ISSUES = "Looks good — no obvious issues detected."
NO_COMMENTS = "Dataset has no comments."
IMBALANCE = (3, 8, '%s "%s" is %s× more common than "%s".')
LOW_COVERAGE = "Less than half the dataset is annotated (%s/%s)."
NEAR_COPIES = "%s near-duplicate comment%s detected."


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", half_up(value, 1))


def readiness() -> Column:
    """``struct(level, score, reasons)``."""
    total, annotated = F.col("total"), F.col("annotated")
    coverage = annotated * 100.0 / F.nullif(total, F.lit(0))
    duplicates = F.col("duplicate_count")
    dup_share = duplicates * 100.0 / F.nullif(total, F.lit(0))

    def below(value: Column, rules, shown: Column):
        return [(value < bound, cost, F.format_string(text, shown)) for bound, cost, text in rules]

    def axis(prefix: str, classes, balance):
        bound, cost, text = classes
        score = F.col(f"{prefix}_balance_score")
        few = (F.col(f"{prefix}_classes") < bound, cost, F.lit(text))
        return [few, *below(score, balance, plain_number(score, 3))]

    copies = [
        (dup_share > bound, cost, F.format_string(text, *[duplicates.cast("string"), _one_decimal(dup_share)][: text.count("%s")]))
        for bound, cost, text in COPIES
    ]
    # Within a group the first true condition counts.
    groups = [
        below(coverage, COVERAGE, _one_decimal(coverage)),
        below(total, SIZE, total.cast("string")),
        axis("s", SENTIMENT_CLASSES, SENTIMENT_BALANCE),
        axis("t", TYPE_CLASSES, TYPE_BALANCE),
        copies,
    ]
    penalties, messages = [], []
    for cases in groups:
        cost, text = F.lit(0), F.lit(None).cast("string")
        for condition, penalty, message in reversed(cases):
            cost = F.when(condition, F.lit(penalty)).otherwise(cost)
            text = F.when(condition, message).otherwise(text)
        penalties.append(cost)
        messages.append(text)
    score = F.lit(100)
    for penalty in penalties:
        score = score - penalty
    score = F.greatest(F.lit(0), score)
    level = F.lit("not_ready")
    for bound, name in reversed(LEVELS):
        level = F.when(score >= bound, F.lit(name)).otherwise(level)
    reasons = F.array_compact(F.array(*messages))
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(
        F.array(F.lit(NO_ISSUES))
    )
    nothing = total == 0
    return F.struct(
        F.when(nothing, F.lit("empty")).otherwise(level).alias("level"),
        F.when(nothing, F.lit(0)).otherwise(score).alias("score"),
        F.when(nothing, F.array(F.lit(NO_COMMENTS))).otherwise(reasons).alias("reasons"),
    )


def warnings() -> Column:
    """``array<struct(kind, severity, message)>`` in fixed order."""
    none = F.lit(None).cast("struct<kind:string,severity:string,message:string>")

    def warning(kind, severity, message):
        return F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), message.alias("message"))

    def imbalance(axis, kind, word):
        medium, high, text = IMBALANCE
        ratio = F.col(f"{axis}_imbalance_ratio")
        said = F.format_string(
            text, F.lit(word), F.col(f"{axis}_top"), plain_number(ratio, 2), F.col(f"{axis}_bottom")
        )
        severity = F.when(ratio >= high, F.lit("high")).otherwise(F.lit("medium"))
        return F.when(ratio >= medium, warning(kind, severity, said)).otherwise(none)

    total, annotated, duplicates = F.col("total"), F.col("annotated"), F.col("duplicate_count")
    said = F.format_string(LOW_COVERAGE, annotated.cast("string"), total.cast("string"))
    coverage = F.when(
        (total > 0) & (annotated * 2 < total), warning("low_annotation_coverage", F.lit("high"), said)
    ).otherwise(none)
    plural = F.when(duplicates == 1, F.lit("")).otherwise(F.lit("s"))
    many = duplicates / F.nullif(total, F.lit(0)).cast("double") > 0.1
    copies = F.when(
        duplicates > 0,
        warning(
            "near_duplicates", F.when(many, F.lit("high")).otherwise(F.lit("low")),
            F.format_string(NEAR_COPIES, duplicates.cast("string"), plural),
        ),
    ).otherwise(none)
    return F.array_compact(
        F.array(
            imbalance("s", "sentiment_imbalance", "Sentiment"),
            imbalance("t", "type_imbalance", "Type"),
            coverage,
            copies,
        )
    )
