"""Append-only comment history: folding change logs into versions, snapshots, diffs.

A log row has ``seq``, a number that grows with the log; it is the order of the
changes and the position used to cut a much edited comment into blocks.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.labels import derive_status
from labelmill.functions.text import trimmed
from labelmill.operators import hotkeys
from labelmill.operators.sizes import broadcast_if_small
from labelmill.operators.vocabulary import check_labels
from labelmill.staging import staged

SNAPSHOT_FIELDS = ("text", "sentiment", "type", "status", "assigned_to", "annotated_by", "annotated_at", "note")


@dataclass(frozen=True)
class Changes:
    """The state after a log, the versions it adds, and the rows it refused or found to change nothing."""

    comments: DataFrame
    versions: DataFrame
    rejects: DataFrame


def version_rows(rows: DataFrame, change_type: str, restored_from: Column | None = None) -> DataFrame:
    """Rows holding the snapshot fields plus version, changed_fields, changed_by, created_at."""
    none = F.lit(None).cast("bigint")
    return rows.select(
        "comment_id", "version", F.struct(*SNAPSHOT_FIELDS).alias("snapshot"), "changed_fields",
        F.lit(change_type).alias("change_type"),
        (none if restored_from is None else restored_from).alias("restored_from"),
        "changed_by", "created_at",
    )


def _changed(old: str, new: str) -> Column:
    return ~F.col(old).eqNullSafe(F.col(new))


def fold_patches(
    comments: DataFrame, patches: DataFrame, options: DataFrame, limit: int = hotkeys.KEY_ROW_LIMIT
) -> tuple[DataFrame, DataFrame, hotkeys.Cut]:
    """Patches (comment_id, seq, sentiment, type, note, has_note, user_id, at) to effective changes.

    Returns (effective patches with the state after each, refused patches, the cut of much patched comments).
    A null sentiment or type means "leave", ``has_note`` marks a set note, null included. A comment stands
    in line before its patches, so the log is partitioned and sorted once, and refused patches stay in line without effect.
    """
    base = F.struct("dataset_id", "sentiment", "type", "note", "status", "version")
    named = comments.join(patches.select("comment_id").distinct(), "comment_id", "left_semi")
    start = named.select("comment_id", F.lit(0).alias("_late"), base.alias("_base"))
    late = patches.select("comment_id", "seq", "sentiment", "type", "note", "has_note", "user_id", "at", F.lit(1).alias("_late"))
    order = ["_late", "seq"]
    cut = hotkeys.cut_keys(late, ["comment_id"], order, limit)
    rows = late.unionByName(start, allowMissingColumns=True)
    rows = hotkeys.scan(rows, cut, order, {"_b": ("last", F.col("_base"))}).where("_late = 1").drop("_base")
    checked = check_labels(rows.withColumn("dataset_id", F.col("_b.dataset_id")), options)
    reason = (
        F.when(F.col("dataset_id").isNull(), F.lit("Comment not found"))
        .when(F.col("bad_label").isNotNull(), F.concat(F.lit("Invalid "), F.col("bad_label"), F.lit(" value")))
    )
    checked = checked.withColumn("reason", reason).drop("bad_label")
    refused = checked.where(F.col("reason").isNotNull())
    good = F.col("reason").isNull()
    # A set note travels in a struct, so a note set to null is not lost by ignoring nulls.
    state = hotkeys.scan(
        checked, cut, order,
        {
            "_f_sentiment": ("last", F.when(good, F.col("sentiment"))), "_f_type": ("last", F.when(good, F.col("type"))),
            "_f_note": ("last", F.when(good & F.col("has_note"), F.struct(F.col("note").alias("v")))),
        },
    ).withColumns(
        {
            "_sentiment": F.coalesce("_f_sentiment", "_b.sentiment"),
            "_type": F.coalesce("_f_type", "_b.type"),
            "_note": F.when(F.col("_f_note").isNull(), F.col("_b.note")).otherwise(F.col("_f_note.v")),
        }
    )
    fields = ["_sentiment", "_type", "_note"]
    state = hotkeys.previous_row(state, cut, order, fields, "_prev")
    state = state.withColumns(
        {
            f"_old{f}": F.when(F.col("_prev").isNull(), F.col(f"_b.{f[1:]}")).otherwise(F.col(f"_prev.{f}"))
            for f in fields
        }
    )
    effective = (
        _changed("_old_sentiment", "_sentiment")
        | _changed("_old_type", "_type")
        | _changed("_old_note", "_note")
    )
    numbered = hotkeys.scan(state, cut, order, {"_n": ("sum", effective.cast("bigint"))}).where(effective)
    old_status = F.when(F.col("_n") == 1, F.col("_b.status")).otherwise(
        derive_status(F.col("_old_sentiment"), F.col("_old_type"))
    )
    folded = numbered.withColumns(
        {"status": derive_status(F.col("_sentiment"), F.col("_type")), "_old_status": old_status}
    )
    fields_changed = F.array_compact(
        F.array(
            F.when(_changed("_old_sentiment", "_sentiment"), F.lit("sentiment")),
            F.when(_changed("_old_type", "_type"), F.lit("type")),
            F.when(_changed("_old_note", "_note"), F.lit("annotationNote")),
            F.when(_changed("_old_status", "status"), F.lit("status")),
        )
    )
    out = folded.select(
        "comment_id", "dataset_id", "seq", (F.col("_b.version") + F.col("_n")).alias("version"),
        F.col("_sentiment").alias("sentiment"), F.col("_type").alias("type"), "status",
        F.col("_note").alias("note"), fields_changed.alias("changed_fields"), "user_id", "at",
    )
    return out, refused.select("comment_id", "seq", "reason"), cut


def _with_texts(rows: DataFrame, texts: DataFrame, cut: hotkeys.Cut) -> DataFrame:
    """``rows`` with the columns of ``texts`` (one row a comment). Much patched comments are few, so theirs are sent to
    the rows where they are when small; the other rows meet theirs by comment."""
    if cut.hot is None:
        return rows.join(texts, "comment_id")
    hot = staged(cut.hot.select(F.col("_h_comment_id").alias("comment_id")), "hot-ids")
    theirs = broadcast_if_small(staged(texts.join(F.broadcast(hot), "comment_id", "left_semi"), "hot-texts"))
    return rows.join(theirs, "comment_id").unionByName(
        rows.join(F.broadcast(hot), "comment_id", "left_anti").join(texts, "comment_id")
    )


def _latest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The last row per comment, folded map-side."""
    return rows.groupBy("comment_id").agg(
        F.max_by(F.struct(*columns), F.col("version")).alias("_last")
    )


def _overlay(comments: DataFrame, latest: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace columns of the comments that have a ``_last`` row."""
    joined = comments.join(latest, "comment_id", "left")
    touched = F.col("_last").isNotNull()
    return joined.withColumns(
        {
            c: F.when(touched, F.col(f"_last.{src}")).otherwise(F.col(c)).alias(c)
            for c, src in columns.items()
        }
    ).drop("_last")


def apply_annotations(
    comments: DataFrame, patches: DataFrame, options: DataFrame, change_type: str = "annotation",
    limit: int = hotkeys.KEY_ROW_LIMIT,
) -> Changes:
    """Apply a patch log in order; one version per patch that changes something."""
    folded, refused, cut = fold_patches(comments, patches, options, limit)
    # The new state and the versions both read the folded log, which is narrow, so it is written once.
    folded = staged(folded, "folded")
    last = _latest(folded, ["sentiment", "type", "status", "note", "version", "user_id", "at"])
    after = _overlay(
        comments, last,
        {
            "sentiment": "sentiment", "type": "type", "status": "status", "note": "note",
            "version": "version", "annotated_by": "user_id", "annotated_at": "at",
            "updated_by": "user_id", "updated_at": "at",
        },
    )
    text = comments.select("comment_id", "text", "assigned_to")
    versions = version_rows(
        _with_texts(folded, text, cut).withColumns(
            {
                "annotated_by": F.col("user_id"), "annotated_at": F.col("at"),
                "changed_by": F.col("user_id"), "created_at": F.col("at"),
            }
        ),
        change_type,
    )
    return Changes(after, versions, refused)


def apply_text_edits(comments: DataFrame, edits: DataFrame, limit: int = hotkeys.KEY_ROW_LIMIT) -> Changes:
    """Edits (comment_id, seq, text, user_id, at): every accepted edit is a version."""
    base = comments.drop("text")
    joined = edits.select(
        "comment_id", "seq", F.col("text").alias("_new"), "user_id", "at"
    ).join(base, "comment_id", "left")
    reason = (
        F.when(F.coalesce("_new", F.lit("")) == "", F.lit("commentText is required"))
        .when(F.col("dataset_id").isNull(), F.lit("Comment not found"))
    )
    joined = joined.withColumn("reason", reason)
    refused = joined.where(F.col("reason").isNotNull()).select("comment_id", "seq", "reason")
    good = joined.where(F.col("reason").isNull()).withColumn("text", trimmed(F.col("_new")))
    cut = hotkeys.cut_keys(edits, ["comment_id"], "seq", limit)
    good = hotkeys.row_number(good, cut, ["seq"], "_n")
    good = good.withColumns(
        {
            "version": F.col("version") + F.col("_n"),
            "changed_fields": F.array(F.lit("commentText")),
            "changed_by": F.col("user_id"), "created_at": F.col("at"),
        }
    )
    last = _latest(good, ["text", "version", "user_id", "at"])
    after = _overlay(
        comments, last,
        {"text": "text", "version": "version", "updated_by": "user_id", "updated_at": "at"},
    )
    return Changes(after, version_rows(good, "update"), refused)


def restore_versions(
    comments: DataFrame, versions: DataFrame, requests: DataFrame, limit: int = hotkeys.KEY_ROW_LIMIT
) -> Changes:
    """Requests (comment_id, version, user_id, at): back to a snapshot as a new version.

    Several requests for a comment are applied by time, then user and version; each makes a version.
    """
    asked = requests.select("comment_id", F.col("version").alias("_target"), "user_id", "at")
    snaps = versions.select("comment_id", F.col("version").alias("_target"), "snapshot")
    found = asked.join(snaps, ["comment_id", "_target"], "left").join(
        comments.select("comment_id", F.col("version").alias("_current")), "comment_id", "left"
    )
    reason = (
        F.when(F.col("_current").isNull(), F.lit("Comment not found"))
        .when(F.col("snapshot").isNull(), F.lit("Version not found"))
    )
    found = found.withColumn("reason", reason)
    refused = found.where(F.col("reason").isNotNull()).select(
        "comment_id", F.col("_target").alias("version"), "reason"
    )
    good = found.where(F.col("reason").isNull())
    order = ["at", "user_id", "_target"]
    good = hotkeys.row_number(good, hotkeys.cut_keys(good, ["comment_id"], order, limit), order, "_n")
    good = good.select(
        "comment_id", (F.col("_current") + F.col("_n")).alias("version"), F.col("_target").alias("_from"),
        "user_id", "at", "snapshot.*",
    )
    columns = ["text", "sentiment", "type", "status", "note", "version", "user_id", "at"]
    after = _overlay(
        comments, _latest(good, columns),
        {
            "text": "text", "sentiment": "sentiment", "type": "type", "status": "status",
            "note": "note", "version": "version", "updated_by": "user_id", "updated_at": "at",
        },
    )
    added = version_rows(
        good.withColumns(
            {
                "changed_fields": F.array(F.lit("restore")), "changed_by": F.col("user_id"),
                "created_at": F.col("at"),
            }
        ),
        "restore", F.col("_from"),
    )
    return Changes(after, added, refused)


def state_as_of(
    versions: DataFrame, key: str = "comment_id", number: str = "version",
    version: int | None = None, at: datetime | None = None,
) -> DataFrame:
    """The snapshot in force per key: latest, up to a version, or up to a moment."""
    rows = versions
    if version is not None:
        rows = rows.where(F.col(number) <= version)
    if at is not None:
        rows = rows.where(F.col("created_at") <= F.lit(at))
    return rows.groupBy(key).agg(
        F.max(number).alias(number), F.max_by("snapshot", F.col(number)).alias("snapshot")
    )


def version_history(
    versions: DataFrame, key_value: str, page: int = 1, limit: int = 20,
    key: str = "comment_id", number: str = "version",
) -> DataFrame:
    """One key's versions, newest first, one page."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    rows = versions.where(F.col(key) == key_value)
    return rows.orderBy(F.col(number).desc()).offset((page - 1) * limit).limit(limit)


def version_diff(
    versions: DataFrame, fields: Sequence[str], key: str = "comment_id", number: str = "version",
    limit: int = hotkeys.KEY_ROW_LIMIT,
) -> DataFrame:
    """Which snapshot fields differ from the version before; the first version differs in every set field."""
    rows = versions.select(key, number, *[F.col(f"snapshot.{f}").alias(f) for f in fields])
    cut = hotkeys.cut_keys(rows, [key], number, limit)
    paired = hotkeys.previous_row(rows, cut, [number], list(fields), "_prev")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_prev.{f}")), F.lit(f)) for f in fields])
    )
    return paired.select(key, number, changed.alias("changed_fields"))
