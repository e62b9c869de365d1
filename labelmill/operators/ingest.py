"""From raw rows to comments: row checks, id clashes, labels, the import report, the preview.

Input rows carry a scope column (one file or one dataset), ``row_no`` counted
from 0 within the scope, and string columns id, comment_text, sentiment, type.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import labels
from labelmill.functions.text import clip_preview, trimmed
from labelmill.operators import hotkeys
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

# How many messages, ids and sample rows a report or a preview shows.
REPORT_ERRORS = 20
PREVIEW_ERRORS = 10
PREVIEW_IDS = 20
PREVIEW_SAMPLE = 10


def _line() -> Column:
    """The file line of a row: the header is line 1."""
    return (F.col("row_no") + 2).cast("string")


def _quoted(value) -> Column:
    return F.concat(F.lit('"'), F.col(value), F.lit('"'))


def _source_id() -> Column:
    return F.coalesce(trimmed(F.col("id").cast("string")), F.lit(""))


def _cleaned(rows: DataFrame) -> DataFrame:
    """Rows with trimmed ``source_id`` and ``text``, and whether they have both."""
    return rows.withColumns(
        {
            "source_id": _source_id(),
            "text": F.coalesce(trimmed(F.col("comment_text")), F.lit("")),
        }
    ).withColumn("_valid", (F.col("source_id") != "") & (F.col("text") != ""))


def _clashes(cleaned: DataFrame, scope: str) -> DataFrame:
    """``scope, row_no, source_id`` of the valid rows behind the first of their id.

    The first row of each id is a map-side minimum, and the others are what is left by row
    number, so an id repeated on a third of all rows spreads evenly. Texts stay where they are.
    """
    narrow = cleaned.where("_valid").select(scope, "row_no", "source_id")
    firsts = narrow.groupBy(scope, "source_id").agg(F.min("row_no").alias("row_no")).select(scope, "row_no")
    return narrow.join(firsts, [scope, "row_no"], "left_anti")


def _outcomes(cleaned: DataFrame, found: DataFrame, scope: str) -> DataFrame:
    """``cleaned`` with the columns of ``found`` for its rows (scope, row_no) and ``outcome`` for the others.

    Only what became of unusual rows travels: to every task when it is small, else rows meet it in one exchange.
    """
    usual = F.when(~F.col("_valid"), "missing").otherwise("keep")
    joined = cleaned.join(broadcast_if_small(found.withColumnRenamed("outcome", "_found")), [scope, "row_no"], "left")
    return joined.withColumn("outcome", F.coalesce("_found", usual)).drop("_found", "_valid", "id", "comment_text")


def mark_rows(rows: DataFrame, scope: str) -> DataFrame:
    """Add source_id, text, and ``outcome``: keep, missing or duplicate (of an earlier valid row)."""
    cleaned = _cleaned(rows)
    clashes = staged(_clashes(cleaned, scope).select(scope, "row_no", F.lit("duplicate").alias("outcome")), "clashes")
    return _outcomes(cleaned, clashes, scope)


def renamed_ids(
    clashes: DataFrame, rows: DataFrame, scope: str, limit: int = hotkeys.KEY_ROW_LIMIT
) -> DataFrame:
    """``scope, row_no, new_id`` of clashing rows: the k-th copy of ``x`` gets the k-th free ``x-dupN``.

    N is free when no raw id in the scope is ``x-dupN``. With o the copy's
    ordinal and b_1 < b_2 < … the taken numbers, N = o + #{i : b_i - i < o},
    so one running count replaces trying names in turn. The last ``-dupN``
    names the base, so ids of different bases never clash.
    """
    copies = clashes.select(scope, F.col("source_id").alias("base"), "row_no")
    key = [scope, "base"]
    cut = hotkeys.cut_keys(copies, key, "row_no", limit)
    copies = hotkeys.row_number(copies, cut, ["row_no"], "_o")
    pattern = r"(?s)^(.*)-dup([1-9][0-9]{0,15})$"
    taken = (
        rows.select(scope, _source_id().alias("source_id"))
        .where(F.col("source_id").rlike(pattern))
        .select(
            scope,
            F.regexp_extract("source_id", pattern, 1).alias("base"),
            F.regexp_extract("source_id", pattern, 2).cast("bigint").alias("_b"),
        )
        .distinct()
        .join(copies.select(*key).distinct(), key, "left_semi")
    )
    taken = hotkeys.row_number(taken, hotkeys.cut_keys(taken, key, "_b", limit), ["_b"], "_i")
    steps = copies.select(*key, "row_no", F.col("_o").alias("_at"), F.lit(0).alias("_taken")).unionByName(
        taken.select(
            *key, F.lit(None).cast("bigint").alias("row_no"),
            (F.col("_b") - F.col("_i")).alias("_at"), F.lit(1).alias("_taken"),
        )
    )
    cut = hotkeys.cut_keys(steps, key, ["_at", "_taken", "row_no"], limit)
    steps = hotkeys.running_sum(steps, cut, ["_at", "_taken", "row_no"], F.col("_taken"), "_skip")
    number = (F.col("_at") + F.col("_skip")).cast("string")
    return steps.where(F.col("_taken") == 0).select(
        scope, "row_no", F.concat(F.col("base"), F.lit("-dup"), number).alias("new_id")
    )


def dedupe_rows(
    rows: DataFrame, scope: str, strategy: str = "skip", limit: int = hotkeys.KEY_ROW_LIMIT, existing: DataFrame | None = None
) -> DataFrame:
    """Marked rows with ``outcome`` keep, missing, duplicate, renamed or exists and a ``message`` per clash.

    ``existing`` holds keys (scope, source_id) that are taken already; the rows that would get them have the outcome exists.
    """
    if strategy not in ("skip", "rename"):
        raise ValueError("strategy must be skip or rename")
    cleaned = _cleaned(rows)
    clashes = staged(_clashes(cleaned, scope), "clashes")
    if strategy == "skip":
        new_id, outcome, what = F.lit(None).cast("string"), "duplicate", F.lit(" skipped")
        found = clashes.withColumn("new_id", new_id)
    else:
        outcome, what = "renamed", F.concat(F.lit(" renamed to "), _quoted("new_id"))
        found = clashes.join(renamed_ids(clashes, rows, scope, limit), [scope, "row_no"])
    message = F.concat(F.lit("Row "), _line(), F.lit(": duplicate id "), _quoted("source_id"), what)
    found = found.select(scope, "row_no", F.lit(outcome).alias("outcome"), "new_id", message.alias("message"))
    if existing is not None:
        found = staged(found, "outcomes")
        firsts = cleaned.where("_valid").select(scope, "row_no", "source_id").join(clashes, [scope, "row_no"], "left_anti")
        none = F.lit(None).cast("string")
        wanted = firsts.select(scope, "row_no", "source_id", none.alias("new_id"), none.alias("message")).unionByName(
            found.where("outcome = 'renamed'").select(scope, "row_no", F.col("new_id").alias("source_id"), "new_id", "message")
        )
        # Keys only, of the scopes that the rows have.
        taken = existing.select(scope, "source_id").join(broadcast_if_small(rows.select(scope).distinct()), scope, "left_semi")
        there = staged(wanted.join(taken, [scope, "source_id"], "left_semi"), "existing")
        found = found.join(there.select(scope, "row_no"), [scope, "row_no"], "left_anti").unionByName(
            there.select(scope, "row_no", F.lit("exists").alias("outcome"), "new_id", "message")
        )
    marked = _outcomes(cleaned, staged(found, "outcomes"), scope)
    return marked.withColumn("source_id", F.coalesce("new_id", "source_id")).drop("new_id")


def comment_key(dataset_id: Column, source_id: Column) -> Column:
    """A stable 24-hex id, so a re-run of an import writes the same ids."""
    return F.substring(F.sha2(F.concat_ws("\u0001", dataset_id, source_id), 256), 1, 24)


def first_listed(rows: DataFrame, scope: str, order: str, value: Column, n: int, name: str) -> DataFrame:
    """The first ``n`` values per scope as an array; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(scope).orderBy(order)
    top = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("r"), value.alias("v"))))
    return top.groupBy(scope).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


@dataclass(frozen=True)
class ImportResult:
    """``messages`` has every message (dataset_id, row_no, message); the report shows the first ones."""

    comments: DataFrame
    versions: DataFrame
    rejects: DataFrame
    messages: DataFrame
    report: DataFrame


def import_comments(
    rows: DataFrame, user: str, as_of: datetime, strategy: str = "skip",
    existing: DataFrame | None = None, options: DataFrame | None = None,
    limit: int = hotkeys.KEY_ROW_LIMIT, shown: int = REPORT_ERRORS,
) -> ImportResult:
    """Rows scoped by ``dataset_id`` to new comments, their first versions, rejects and a report.

    Labels are checked against the default vocabularies, or against
    ``options`` (dataset_id, sentiments, types) when given. Keys already in
    ``existing`` are skipped and counted.
    """
    checked = dedupe_rows(rows, "dataset_id", strategy, limit, existing)
    wanted = F.col("outcome").isin("keep", "renamed")
    if options is not None:
        labelled = checked.join(broadcast_if_small(options), "dataset_id", "left")

        def coerced(column, allowed, fallback):
            cleaned = trimmed(F.lower(F.col(column)))
            return F.when(F.array_contains(allowed, cleaned), cleaned).otherwise(F.lit(fallback))

        labelled = labelled.withColumns(
            {
                "sentiment": coerced("sentiment", "sentiments", labels.NO_SENTIMENT),
                "type": coerced("type", "types", labels.NO_TYPE),
            }
        ).drop("sentiments", "types")
    else:
        labelled = checked.withColumns(
            {
                "sentiment": labels.coerce_label(
                    F.col("sentiment"), labels.DEFAULT_SENTIMENTS[:3], labels.NO_SENTIMENT
                ),
                "type": labels.coerce_label(F.col("type"), labels.DEFAULT_TYPES[:3], labels.NO_TYPE),
            }
        )
    # Four outputs read the checked rows, so they are written once.
    labelled = staged(labelled, "import")
    checked = labelled
    now = F.lit(as_of).cast("timestamp")
    nobody = F.lit(None).cast("string")
    status = labels.derive_status(F.col("sentiment"), F.col("type"))
    done = F.col("status") == labels.ANNOTATED
    comments = (
        labelled.where(wanted)
        .withColumn("status", status)
        .select(
            comment_key(F.col("dataset_id"), F.col("source_id")).alias("comment_id"),
            "dataset_id", "source_id", "text", "sentiment", "type", "status",
            nobody.alias("assigned_to"), F.lit(None).cast("timestamp").alias("assigned_at"),
            nobody.alias("assigned_by"),
            F.when(done, F.lit(user)).alias("annotated_by"),
            F.when(done, now).alias("annotated_at"),
            nobody.alias("note"), F.lit(1).cast("bigint").alias("version"),
            F.lit(user).alias("created_by"), F.lit(user).alias("updated_by"),
            now.alias("created_at"), now.alias("updated_at"),
        )
    )
    versions = comments.select(
        "comment_id", "version",
        F.struct(
            "text", "sentiment", "type", "status", "assigned_to", "annotated_by", "annotated_at", "note"
        ).alias("snapshot"),
        F.array(*[F.lit(f) for f in ("commentText", "sentiment", "type", "status")]).alias("changed_fields"),
        F.lit("import").alias("change_type"),
        F.lit(None).cast("bigint").alias("restored_from"),
        F.lit(user).alias("changed_by"),
        now.alias("created_at"),
    )
    rejects = checked.where(~wanted).select(
        "dataset_id", "row_no", "source_id", F.col("outcome").alias("reason"), "message"
    )
    imported = F.count_if(wanted)
    insertable = F.count_if(F.col("outcome").isin("keep", "renamed", "exists"))
    messages = checked.where(F.col("message").isNotNull()).select("dataset_id", "row_no", "message")
    errors = first_listed(messages, "dataset_id", "row_no", F.col("message"), shown, "import_errors")
    report = (
        checked.groupBy("dataset_id")
        .agg(
            F.count("*").alias("total_rows"),
            imported.alias("imported_rows"),
            F.count_if(~wanted).alias("skipped_rows"),
            F.count_if(F.col("outcome") == "renamed").alias("renamed_rows"),
            F.when(insertable > 0, "completed").otherwise("failed").alias("status"),
            F.when(insertable == 0, "No valid rows found").alias("import_error"),
        )
        .join(errors, "dataset_id", "left")
        .withColumn("import_errors", F.coalesce("import_errors", F.array().cast("array<string>")))
    )
    return ImportResult(comments, versions, rejects, messages, report)


def import_preview(rows: DataFrame, scope: str = "file") -> DataFrame:
    """One row per file: counts, the first clashing ids, a sample and the first messages."""
    # Six aggregates read the marked rows, so they are written once, with the clipped text only.
    marked = staged(
        mark_rows(rows, scope).withColumn("text", clip_preview(F.col("text"))), "preview"
    )
    copies = marked.where(F.col("outcome") == "duplicate")
    counts = marked.groupBy(scope).agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("outcome") == "keep").alias("valid_rows"),
        F.count_if(F.col("outcome") == "missing").alias("missing_id_or_text"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
    )
    per_id = copies.groupBy(scope, "source_id").agg(F.min("row_no").alias("row_no"))
    unique = per_id.groupBy(scope).agg(F.count("*").alias("unique_duplicate_count"))
    ids = first_listed(per_id, scope, "row_no", F.col("source_id"), PREVIEW_IDS, "duplicate_ids")
    sample = first_listed(
        marked.where(F.col("outcome") == "keep"), scope, "row_no",
        F.struct(
            F.col("source_id"), F.col("text"),
            F.nullif("sentiment", F.lit("")).alias("sentiment"), F.nullif("type", F.lit("")).alias("type"),
        ),
        PREVIEW_SAMPLE, "sample",
    )
    w = Window.partitionBy(scope).orderBy("row_no")
    early = copies.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= PREVIEW_ERRORS)
    firsts = (
        marked.where(F.col("outcome") == "keep")
        .select(scope, "source_id", (F.col("row_no") + 2).alias("_first"))
    )
    message = F.concat(
        F.lit("Row "), _line(), F.lit(": duplicate id "), _quoted("source_id"),
        F.lit(" (first at row "), F.col("_first").cast("string"), F.lit(")"),
    )
    errors = first_listed(
        early.join(firsts, [scope, "source_id"]), scope, "row_no", message, PREVIEW_ERRORS, "errors"
    )
    name = F.element_at(F.split(F.col(scope), "/"), -1)
    out = counts
    for part in (unique, ids, sample, errors):
        out = out.join(part, scope, "left")
    return out.withColumns(
        {
            "unique_duplicate_count": F.coalesce("unique_duplicate_count", F.lit(0)),
            "suggested_name": F.regexp_replace(name, r"(?i)\.(csv|xlsx)$", ""),
        }
    )
