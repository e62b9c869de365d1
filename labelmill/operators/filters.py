"""Row filters. Each returns a plain ``filter``, so Parquet pushdown applies."""

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import WHITE_SPACE, trimmed

_UNSET = object()


def _nothing() -> Column:
    return F.lit(False)


def _equals(column: Column, value) -> Column:
    return column.isNull() if value is None else F.coalesce(column == F.lit(value), F.lit(False))


def _one_of(column: Column, values) -> Column:
    known = [v for v in values if v is not None]
    hit = F.coalesce(column.isin(known), F.lit(False)) if known else _nothing()
    return hit | column.isNull() if None in list(values) else hit


def _all_equal(wanted: Mapping) -> Column:
    """Every named column holds its value; none asked for means no condition."""
    test = F.lit(True)
    for name, value in wanted.items():
        test = test & _equals(F.col(name), value)
    return test


def _between(column: str, start, end) -> Column:
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= F.lit(start))
    if end is not None:
        test = test & (F.col(column) <= F.lit(end))
    return test


def _status(status, exclude_annotated: bool) -> Column:
    if status:
        return F.col("status") == status
    if exclude_annotated:
        return ~_equals(F.col("status"), "annotated")
    return F.lit(True)


def filter_comments(
    df: DataFrame, *, ids=None, dataset_id: str | None = None, dataset_ids=None, source_id=None,
    status=None, exclude_annotated=False, sentiment=None, type=None, annotated_by=None,
    annotated_from: datetime | None = None, annotated_to: datetime | None = None,
    assigned_to=_UNSET, search: str | None = None,
) -> DataFrame:
    """Comments matching every given condition; ``status`` wins over ``exclude_annotated``."""
    test = _status(status, exclude_annotated)
    if ids is not None:
        test = test & _one_of(F.col("comment_id"), [i for i in ids if i])
    if dataset_ids is not None:
        allowed = [i for i in dataset_ids if i]
        if dataset_id:
            allowed = [dataset_id] if dataset_id in allowed else []
        test = test & _one_of(F.col("dataset_id"), allowed)
    elif dataset_id:
        test = test & (F.col("dataset_id") == dataset_id)
    if source_id is not None:
        test = test & (F.col("source_id") == str(source_id))
    if sentiment:
        test = test & (F.col("sentiment") == sentiment)
    if type:
        test = test & (F.col("type") == type)
    if annotated_by:
        test = test & (F.col("annotated_by") == annotated_by)
    if annotated_from or annotated_to:
        test = test & _between("annotated_at", annotated_from, annotated_to)
    if assigned_to is not _UNSET:
        test = test & _equals(F.col("assigned_to"), assigned_to)
    phrase = (search or "").strip(WHITE_SPACE)
    if phrase:
        test = test & F.contains(F.lower("text"), F.lower(F.lit(phrase)))
    return df.where(test)


def filter_datasets(
    df: DataFrame, *, status=None, assigned_to=None, uploaded_by=None, taxonomy_id=None
) -> DataFrame:
    wanted = {
        "status": status, "assigned_to": assigned_to,
        "uploaded_by": uploaded_by, "taxonomy_id": taxonomy_id,
    }
    return df.where(_all_equal({k: v for k, v in wanted.items() if v}))


def filter_users(df: DataFrame, *, role=None, is_active=None, email=None) -> DataFrame:
    test = F.lit(True)
    if role:
        test = test & (F.col("role") == role)
    if is_active is not None:
        test = test & (F.col("is_active") == is_active)
    if email:
        test = test & (F.col("email") == trimmed(F.lower(F.lit(email))))
    return df.where(test)


def filter_audit(
    df: DataFrame, *, action=None, actor_id=None, target_type=None, target_id=None,
    at_from: datetime | None = None, at_to: datetime | None = None,
) -> DataFrame:
    """Audit events, newest first."""
    wanted = {
        "action": action, "actor_id": actor_id, "target_type": target_type, "target_id": target_id,
    }
    kept = df.where(_all_equal({k: v for k, v in wanted.items() if v}) & _between("at", at_from, at_to))
    return kept.orderBy(F.col("at").desc(), "event_id")


def filter_assets(
    df: DataFrame, *, dataset_id=None, asset_id=None, kind=None, status=None,
    exclude_annotated=False, assigned_to=_UNSET, checksum=None, checksum_in=None, extension=None,
) -> DataFrame:
    test = _status(status, exclude_annotated)
    wanted = {
        "dataset_id": dataset_id, "asset_id": asset_id, "kind": kind,
        "checksum": checksum, "extension": extension,
    }
    test = test & _all_equal({k: v for k, v in wanted.items() if v is not None})
    if assigned_to is not _UNSET:
        test = test & _equals(F.col("assigned_to"), assigned_to)
    if checksum_in is not None:
        test = test & _one_of(F.col("checksum"), [c for c in checksum_in if c])
    return df.where(test)


def filter_annotations(
    df: DataFrame, *, dataset_id=None, asset_id=None, kind=None, label=None, label_in=None,
    frame_index=_UNSET, created_by=None, created_from: datetime | None = None,
    created_to: datetime | None = None, timestamp_ms_from: int | None = None,
    timestamp_ms_to: int | None = None,
) -> DataFrame:
    wanted = {
        "dataset_id": dataset_id, "asset_id": asset_id, "kind": kind,
        "label": label, "created_by": created_by,
    }
    test = _all_equal({k: v for k, v in wanted.items() if v is not None})
    if frame_index is not _UNSET:
        test = test & _equals(F.col("frame_index"), frame_index)
    if label_in is not None:
        test = test & _one_of(F.col("label"), [v for v in label_in if v])
    test = test & _between("created_at", created_from, created_to)
    test = test & _between("timestamp_ms", timestamp_ms_from, timestamp_ms_to)
    return df.where(test)


def filter_sessions(
    df: DataFrame, *, user_id=None, user_ids=None, session_key=None, last_state=None,
    seen_from: datetime | None = None, seen_to: datetime | None = None,
) -> DataFrame:
    """Sessions alive in a window: the bounds are on ``last_seen_at``, not on the start."""
    test = _between("last_seen_at", seen_from, seen_to)
    if user_ids is not None:
        test = test & _one_of(F.col("user_id"), [u for u in user_ids if u])
    elif user_id:
        test = test & (F.col("user_id") == user_id)
    wanted = {"session_key": session_key, "last_state": last_state}
    return df.where(test & _all_equal({k: v for k, v in wanted.items() if v is not None}))


def filter_taxonomies(df: DataFrame, *, is_active=None, admin=True) -> DataFrame:
    """Everyone but an admin sees active taxonomies only."""
    wanted = True if not admin else is_active
    return df if wanted is None else df.where(F.col("is_active") == wanted)
