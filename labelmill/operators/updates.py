"""Table updates as new tables: inserts, upserts, assignment, expiry, cascades, copies.

Plain files have no MERGE, so each function returns the table to write next;
write it beside the old one and swap, never over the path being read.
"""

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns an update never touches.
IMMUTABLE = ("dataset_id", "created_by")
STALE_IMPORT_MESSAGE = "Server restarted during import"


def append_versions(log: DataFrame, new_rows: DataFrame) -> DataFrame:
    return log.unionByName(new_rows)


def insert_new(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], row_id: str
) -> tuple[DataFrame, DataFrame]:
    """(inserted, clashes). A row clashes with an existing key or an earlier row of the batch.

    ``row_id`` is unique in the batch and gives its order. Rows with a null in
    the key never clash. Winners are a map-side minimum and come back by
    ``row_id``, so a repeated key spreads evenly.
    """
    key = list(key)
    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.col(k).isNotNull()
    firsts = incoming.where(has_key).groupBy(*key).agg(F.min(row_id).alias(row_id))
    winners = firsts.join(existing.select(*key), key, "left_anti").select(row_id)
    keyed = incoming.where(has_key)
    inserted = keyed.join(winners, row_id, "left_semi").unionByName(incoming.where(~has_key))
    return inserted, keyed.join(winners, row_id, "left_anti")


def upsert(
    base: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], at: datetime,
    order: str | None = None,
) -> DataFrame:
    """Set ``columns`` from the last patch of the same key; adds ``modified``.

    ``order`` names the column that says which patch of a key is last; without it the greatest
    values are taken, so reruns agree. A null in the patch sets null. Identity and provenance
    columns are refused.
    """
    frozen = {key, *IMMUTABLE} & set(columns)
    if frozen:
        raise ValueError(f"columns cannot be updated: {sorted(frozen)}")
    patch = F.struct(*columns)
    last = F.max_by(patch, F.struct(order, *columns)) if order else F.max(patch)
    side = patches.groupBy(key).agg(last.alias("_patch"))
    joined = base.join(side, key, "left")
    found = F.col("_patch").isNotNull()
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_patch.{c}"))
    marked = joined.withColumn("modified", found & differs)
    new = {c: F.when(found, F.col(f"_patch.{c}")).otherwise(F.col(c)) for c in columns}
    if "updated_at" in base.columns:
        new["updated_at"] = F.when(found, F.lit(at)).otherwise(F.col("updated_at"))
    return marked.withColumns(new).drop("_patch")


def bulk_assign(
    rows: DataFrame, ids: DataFrame, key: str, assignee: str | None, by: str, at: datetime,
    users: DataFrame | None = None,
) -> DataFrame:
    """Assign the listed rows, or unassign with ``None``. The assignee must be an active user."""
    if assignee and users is not None:
        active = users.where((F.col("user_id") == assignee) & F.col("is_active"))
        if active.isEmpty():
            raise ValueError("Assignee not found or inactive")
    chosen = ids.select(key).distinct().withColumn("_chosen", F.lit(True))
    hit = F.col("_chosen").isNotNull()

    def put(value: Column, column: str) -> Column:
        return F.when(hit, value).otherwise(F.col(column))

    when = F.lit(at).cast("timestamp") if assignee else F.lit(None).cast("timestamp")
    return (
        rows.join(chosen, key, "left")
        .withColumns(
            {
                "assigned_to": put(F.lit(assignee or None).cast("string"), "assigned_to"),
                "assigned_at": put(when, "assigned_at"),
                "assigned_by": put(F.lit(by), "assigned_by"),
            }
        )
        .drop("_chosen")
    )


def expire_stale_imports(datasets: DataFrame, cutoff: datetime, as_of: datetime) -> DataFrame:
    """Imports still open at ``cutoff`` become failed."""
    stale = F.col("status").isin("pending", "processing") & (F.col("updated_at") < F.lit(cutoff))
    stale = F.coalesce(stale, F.lit(False))
    return datasets.withColumn("_stale", stale).withColumns(
        {
            "status": F.when(F.col("_stale"), "failed").otherwise(F.col("status")),
            "import_error": F.when(F.col("_stale"), STALE_IMPORT_MESSAGE).otherwise(F.col("import_error")),
            "updated_at": F.when(F.col("_stale"), F.lit(as_of)).otherwise(F.col("updated_at")),
        }
    ).drop("_stale")


def expire_sessions(sessions: DataFrame, as_of: datetime, retention_days: int = 30) -> DataFrame:
    """Sessions seen within the retention."""
    return sessions.where(F.col("last_seen_at") >= F.lit(as_of - timedelta(days=retention_days)))


def delete_cascade(
    tables: Mapping[str, DataFrame], doomed: DataFrame, key: str,
    children: Sequence[tuple[str, str, str]], keys: Mapping[str, str],
) -> dict[str, DataFrame]:
    """Drop the ``doomed`` keys and everything under them.

    ``children`` lists (table, column, parent table) from the top down; the top
    parent is the empty string. ``keys`` names the key column of every table
    that is a parent. A child loses the rows whose parent row is dropped.
    """
    dropped = {"": doomed.select(F.col(key).alias("_gone")).distinct()}
    parents = {parent for _, _, parent in children}
    left = {}
    for table, column, parent in children:
        rows = tables[table]
        missing = {column, *([keys[table]] if table in parents else [])} - set(rows.columns)
        if missing:
            raise ValueError(f"{table} has no column {sorted(missing)}")
        gone = dropped[parent].withColumnRenamed("_gone", column)
        left[table] = rows.join(gone, column, "left_anti")
        if table in parents:
            own = F.col(keys[table]).alias("_gone")
            dropped[table] = rows.join(gone, column, "left_semi").select(own).distinct()
    return left


def copy_key(new_dataset: str, old_id: Column) -> Column:
    """The id of a copied comment: a function of the old one, so versions re-key without a join."""
    return F.substring(F.sha2(F.concat(F.lit(new_dataset), F.lit("\u0001"), old_id), 256), 1, 24)


def duplicate_dataset(
    comments: DataFrame, versions: DataFrame, dataset_id: str, new_dataset: str, user: str, at: datetime
) -> tuple[DataFrame, DataFrame]:
    """Copies of a dataset's comments (assignment cleared) and of their versions."""
    source = comments.where(F.col("dataset_id") == dataset_id)
    now = F.lit(at).cast("timestamp")
    nobody = F.lit(None).cast("string")
    copied = source.withColumns(
        {
            "comment_id": copy_key(new_dataset, F.col("comment_id")),
            "dataset_id": F.lit(new_dataset),
            "assigned_to": nobody, "assigned_at": F.lit(None).cast("timestamp"), "assigned_by": nobody,
            "created_by": F.lit(user), "updated_by": F.lit(user), "created_at": now, "updated_at": now,
        }
    )
    owned = versions.join(source.select("comment_id"), "comment_id", "left_semi")
    history = owned.withColumns(
        {
            "comment_id": copy_key(new_dataset, F.col("comment_id")),
            "changed_by": F.lit(user), "created_at": now,
        }
    ).select(*versions.columns)
    return copied, history
