"""Fold a log of box edits (create, update, delete, restore) into annotations and versions.

Log columns: seq, op, annotation_id, asset_id, kind, label, x, y, width, height,
pixel, frame_index, timestamp_ms, note, has_note, user_id, at, and has_frame if there is need of it. A null
field of an update means "leave", but for a note with ``has_note`` and a frame with ``has_frame``, which are cleared.

All rules are running folds of an annotation's rows in order, so the log is partitioned and sorted once, live
annotations and creates bringing their assets' facts along. Refused rows and restores stay in line as rows that change
nothing, so that a restore of what the log has deleted finds its snapshot in its own row.

Restores make a new annotation with a new id. The log may go on to edit, delete and restore that id: such rows
are applied to what the restore has made, however deep.
"""

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import geometry
from labelmill.functions.numbers import half_up
from labelmill.operators import hotkeys
from labelmill.operators.sizes import broadcast_if_small, is_small
from labelmill.operators.vocabulary import resolve_labels
from labelmill import staging

# Folded states are wide and written once, so smaller files are worth the time. They lie in the order of their ids, of
# which version 2 of the format writes only where one differs from the one before.
staged = partial(staging.staged, compression="zstd", **{"parquet.writer.version": "v2"})

# The fields a version tracks.
TRACKED = ("label", "kind", "note", "x", "y", "boxWidth", "boxHeight", "frameIndex", "timestampMs")

SNAPSHOT = (
    "asset_id", "dataset_id", "kind", "label", "x", "y", "box_width", "box_height", "frame_index",
    "timestamp_ms", "width", "height", "note", "created_by",
)
_TRACKED_COLUMNS = dict(
    zip(TRACKED, ("label", "kind", "note", "x", "y", "box_width", "box_height", "frame_index", "timestamp_ms"))
)
_KEY = ["annotation_id"]


@dataclass(frozen=True)
class Edits:
    annotations: DataFrame
    versions: DataFrame
    rejects: DataFrame


def _assets(assets: DataFrame) -> DataFrame:
    return assets.select(
        "asset_id", F.col("dataset_id").alias("a_dataset_id"), F.col("kind").alias("a_kind"),
        F.col("width").alias("a_width"), F.col("height").alias("a_height"),
        F.col("duration_ms").alias("a_duration"),
    )


def _canonical(edits: DataFrame, classes: DataFrame) -> DataFrame:
    """Labels to class values and pixel sides to fractions, with the reason when that fails."""
    bound = classes.select("dataset_id", F.lit(True).alias("_bound")).distinct()
    edits = edits.withColumn("dataset_id", F.coalesce("dataset_id", F.lit("")))
    named = resolve_labels(edits.join(broadcast_if_small(bound), "dataset_id", "left"), classes)
    asked = F.col("label").isNotNull() | (F.col("op") == "create")
    named = named.withColumns(
        {
            "label_error": F.when(asked, F.col("label_error")),
            "label": F.when(asked, F.col("value")),
        }
    ).drop("value", "class_id")
    pixel = F.coalesce("pixel", F.lit(False))
    sides = ["x", "y", "width", "height"]
    given = F.coalesce(*sides).isNotNull()
    whole = (F.col("x") + F.col("y") + F.col("width") + F.col("height")).isNotNull()
    sized = (F.coalesce("a_width", F.lit(0)) > 0) & (F.coalesce("a_height", F.lit(0)) > 0)
    named = named.withColumns({"_given": given, "_whole": whole, "_pixel": pixel & given})
    # A pixel box on an update must be whole: its sides cannot be mixed with stored fractions.
    pixel_error = (
        F.when(F.col("_pixel") & ~sized, "This image's dimensions are unknown, so a pixel box cannot be converted.")
        .when(F.col("_pixel") & ~F.col("_whole"), "A pixel box needs x, y, width and height")
    )
    scaled = {}
    for s, size in zip(sides, ("a_width", "a_height", "a_width", "a_height")):
        # Dividing by 1 leaves a fraction exactly as it is.
        by = F.when(F.col("_pixel") & (F.col(size) > 0), F.col(size).cast("double")).otherwise(F.lit(1.0))
        scaled[s] = F.col(s) / by
    return named.withColumn("pixel_error", pixel_error).withColumns(scaled)


def _side_error(required: Column) -> Column:
    """Box problems that do not depend on the stored box: a stored box always has 0 <= x,y < 1 and positive sides."""

    missing = required & ~F.col("_whole")
    nonfinite = ~geometry.finite(*[F.coalesce(s, F.lit(0.0)) for s in ("x", "y", "width", "height")])
    return (
        F.when(required & ~F.col("_given"), F.lit("A bbox annotation requires a box"))
        .when(missing | nonfinite, F.lit(geometry.NOT_NUMERIC))
        .when((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(geometry.NOT_POSITIVE))
        .when((F.col("x") >= 1) | (F.col("y") >= 1), F.lit(geometry.OUTSIDE))
    )


def _checked(edits: DataFrame, classes: DataFrame, create: bool) -> DataFrame:
    """Edits with their asset's facts in stored units, with ``reason``: what a single row shows to be wrong."""
    out = _canonical(edits.withColumn("dataset_id", F.col("a_dataset_id")), classes)
    is_create = F.lit(create)
    box_kind = F.col("kind") == "bbox"
    clears = F.coalesce("has_frame", F.lit(False))
    timed = F.col("frame_index").isNotNull() | F.col("timestamp_ms").isNotNull() | clears
    frame_op = box_kind & (F.col("a_kind") == "video") & (is_create | timed)
    frame = geometry.normalize_frame(F.col("frame_index"), F.col("timestamp_ms"), F.col("a_duration"))
    # An update may find its time in an earlier edit, so that rule waits.
    frame_error = frame["reason"] if create else F.nullif(frame["reason"], F.lit(geometry.FRAME_NEEDS_DURATION))
    writes = F.col("op").isin("create", "update")
    reason = (
        F.when(~F.col("op").isin("create", "update", "delete"), F.lit("Unknown operation"))
        .when(F.col("a_kind").isNull(), F.lit("Media asset not found"))
        .when(writes & F.col("_bound").isNull(), F.lit("This dataset has no label set. Assign one before annotating."))
        .when(~F.col("kind").isin("bbox", "classification"), F.lit('kind must be "bbox" or "classification"'))
        .when(writes & F.col("label_error").isNotNull(), F.col("label_error"))
        .when(writes & box_kind & F.col("pixel_error").isNotNull(), F.col("pixel_error"))
        .when(
            writes & box_kind,
            F.coalesce(_side_error(is_create), F.when(frame_op, frame_error)),
        )
    )
    given = frame_op & writes & (F.col("frame_index").isNotNull() | clears)
    return out.withColumns(
        {
            "reason": reason,
            "_boxed": box_kind & (F.col("_given") | is_create) & writes,
            "has_note": (F.coalesce("has_note", F.lit(False)) | is_create) & writes,
            "label": F.when(writes, F.col("label")),
            "_frame": F.when(given, F.struct(F.col("frame_index").cast("bigint").alias("v"))),
            "_time": F.when(frame_op & writes, F.floor(F.col("timestamp_ms").cast("double") + 0.5)),
        }
    ).drop("label_error", "pixel_error", "_bound", "_given", "_whole", "_pixel")


# What the check of a row tells, and the facts that an annotation's first row brings to the others.
JUDGED = ("label", "x", "y", "width", "height", "_boxed", "has_note", "note", "_frame", "_time", "reason")
FACTS = ("asset_id", "kind", "a_dataset_id", "a_kind", "a_width", "a_height", "a_duration")
# Who made it and when; null means the user and the time of the first row itself.
ORIGIN = ("revision", "created")
# Values of first rows that lie in the log's own columns, and those that come in ``_made``.
PLAIN = ("label", "x", "y", "width", "height", "note")
MADE = tuple(c for c in JUDGED if c not in PLAIN) + FACTS + ORIGIN


# Log rows that one task folds, so that their sort stays in memory.
TASK_ROWS = 500_000

# Up to so many partitions Spark writes a shuffle straight to files; beyond, it sorts rows in memory and spills them.
BYPASS = "spark.shuffle.sort.bypassMergeThreshold"
BYPASS_PARTITIONS = 200


def _rounds(log: DataFrame) -> tuple[int, int]:
    """(rounds, tasks of a round) for folding a large log: a round's rows go to so few tasks that none is spilled."""
    most = int(log.sparkSession.sparkContext.getConf().get(BYPASS, str(BYPASS_PARTITIONS)))
    tasks = log.count() // TASK_ROWS
    rounds = tasks // max(most, 1) + 1
    return rounds, tasks // rounds


def _rows(
    annotations: DataFrame, log: DataFrame, assets: DataFrame, classes: DataFrame, cut: hotkeys.Cut, few: bool, tasks: int
) -> DataFrame:
    """The log and the live annotations it names as one table; first rows carry ``_made``."""
    facts = _assets(assets)
    # A large log meets the annotations in the partitions of the folds, where those that it does not name drop out.
    if few or cut.hot is not None:
        ids = log.select("annotation_id")
        annotations = annotations.join(F.broadcast(ids) if few else ids.distinct(), "annotation_id", "left_semi")
    start = annotations.where(F.col("annotation_id").isNotNull()).join(facts.drop("a_width", "a_height"), "asset_id", "left")
    edited = ~(F.col("created_by").eqNullSafe(F.col("updated_by")) & F.col("created_at").eqNullSafe(F.col("updated_at")))
    start = start.withColumn("created", F.when(edited, F.struct("created_by", "created_at")))
    start = start.select(
        "annotation_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("base").alias("op"),
        F.col("updated_by").alias("user_id"), F.col("updated_at").alias("at"), "label", "x", "y",
        F.col("box_width").alias("width"), F.col("box_height").alias("height"), "note",
        F.struct(
            (F.col("kind") == "bbox").alias("_boxed"), F.lit(True).alias("has_note"),
            F.struct(F.col("frame_index").alias("v")).alias("_frame"), F.col("timestamp_ms").alias("_time"),
            F.lit(None).cast("string").alias("reason"),
            "asset_id", "kind", F.col("dataset_id").alias("a_dataset_id"), "a_kind", F.col("width").alias("a_width"),
            F.col("height").alias("a_height"), "a_duration", *ORIGIN,
        ).alias("_made"),
    )
    creates = log.where(F.col("op") == "create").withColumn("kind", F.coalesce("kind", F.lit("bbox")))
    named = creates.select("asset_id")
    if not few and is_small(named):
        # Only the facts of assets that get annotations are moved.
        facts = facts.join(F.broadcast(named), "asset_id", "left_semi")
    creates = _checked(creates.join(facts, "asset_id", "left"), classes, True)
    creates = creates.withColumns({"revision": F.lit(1).cast("bigint"), "created": F.lit(None).cast(start.schema["_made"].dataType["created"].dataType)})
    creates = creates.select("annotation_id", "seq", "op", "user_id", "at", *PLAIN, F.struct(*MADE).alias("_made"))
    applied = F.col("op").isNotNull()
    others = log.where(~F.col("op").eqNullSafe("create")).drop("asset_id", "kind")
    if few or cut.hot is not None:
        return others.where(applied).unionByName(creates, allowMissingColumns=True).unionByName(start, allowMissingColumns=True)
    # Of restores only who asked and when counts, of rows without an operation only the id.
    asked = ("op", "user_id", "at")
    others = others.select(
        "annotation_id", "seq", *[F.when(applied, F.col(c)).alias(c) for c in asked],
        *[F.when(F.col("op") != "restore", F.col(c)).alias(c) for c in others.columns if c not in ("annotation_id", "seq", *asked)],
    )
    rows = others.unionByName(creates, allowMissingColumns=True).unionByName(start, allowMissingColumns=True)
    if tasks > int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, *_KEY)
    live = F.coalesce(F.col("op") == "base", F.lit(False)) & F.col("_made").isNotNull()
    whole = cut.window(["seq"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("_named", F.max(~live).over(whole)).where(F.col("_named") & applied).drop("_named")


def _folded(annotations: DataFrame, log: DataFrame, assets: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """The log folded, a very large one in rounds of ids."""
    cut = hotkeys.cut_keys(log, _KEY, "seq", limit)
    few = is_small(log.select("annotation_id"))
    rounds, tasks = (1, 0) if few or cut.hot is not None else _rounds(log)
    if rounds == 1:
        return _fold(_rows(annotations, log, assets, classes, cut, few, tasks), classes, cut)
    turn = F.pmod(F.xxhash64(*_KEY), F.lit(rounds))
    states = [
        _fold(_rows(annotations.where(turn == k), log.where(turn == k), assets, classes, cut, few, tasks), classes, cut)
        for k in range(rounds)
    ]
    return reduce(DataFrame.unionByName, states)


def _fold(rows: DataFrame, classes: DataFrame, cut: hotkeys.Cut) -> DataFrame:
    """Rows of the log, and live rows before it: why they were refused, or the state after them.

    A restore is refused here when its id was not deleted earlier in this log; ``seen`` is then the first ``seq`` that made
    a version of it. Rows that change nothing and have others after them may be missing.
    """
    opens = F.col("_made").isNotNull() & F.col("_made.reason").isNull()
    by, at = (F.when(F.col("_made.created").isNull(), F.col(own)).otherwise(F.col(f"_made.created.{c}")).alias(c) for own, c in (("user_id", "created_by"), ("at", "created_at")))
    first = F.struct("seq", F.struct(*[F.col(f"_made.{c}") for c in FACTS]).alias("_facts"), F.struct("_made.revision", by, at).alias("_origin"))
    rows = hotkeys.scan(rows, cut, ["seq"], {"_first": ("min", F.when(opens, first))})
    # Other rows are checked by the facts of the annotation's first one.
    made = F.col("_made").isNotNull()
    rows = rows.withColumn("_plain", F.when(made, F.struct(*PLAIN)))
    rows = rows.withColumns({c: F.col(f"_first._facts.{c}") for c in FACTS})
    rows = _checked(rows, classes, False)
    held = {c: "_plain" if c in PLAIN else "_made" for c in JUDGED}
    rows = rows.withColumns({c: F.when(made, F.col(f"{s}.{c}")).otherwise(F.col(c)) for c, s in held.items()})
    created = F.col("op") == "create"
    rows = rows.withColumn(
        "reason",
        F.when(created & (F.col("seq") > F.col("_first.seq")), F.lit("Annotation already exists"))
        .when(~made & F.col("_first").isNull(), F.lit("Annotation not found"))
        .otherwise(F.col("reason")),
    ).drop("_made", "_plain")

    # Restores are refused so far, as no operation that a row alone can judge.
    good = F.col("reason").isNull()
    rows = hotkeys.scan(
        rows, cut, ["seq"],
        {"_ended": ("min", F.when(good & (F.col("op") == "delete"), F.col("seq"))), "_s_time": ("last", F.when(good, F.col("_time")))},
    )
    # A frame without a time needs one from an earlier edit when the duration is unknown.
    untimed = F.col("_frame.v").isNotNull() & F.col("_s_time").isNull() & F.col("a_duration").isNull() & (F.col("op") == "update")
    rows = rows.withColumn(
        "reason",
        F.when(~created & (F.col("seq") > F.col("_ended")), F.lit("Annotation not found"))
        .when(good & untimed, F.lit(geometry.FRAME_NEEDS_DURATION))
        .otherwise(F.col("reason")),
    )

    # --- Fold. A corner is the latest given one, clamped. A size is the latest given one cut by every room (1 - corner)
    # since it was given: a running minimum that starts anew at each given size.
    boxed = good & F.col("_boxed")
    sides = (("x", "width"), ("y", "height"))

    def inside(corner: str) -> Column:
        # greatest and least skip nulls, so a corner that is not given must stay null.
        return F.when(boxed & F.col(corner).isNotNull(), F.least(F.greatest(F.col(corner), F.lit(0.0)), F.lit(1.0)))

    folds = {f"_s_{corner}": ("last", half_up(inside(corner), 6)) for corner, _ in sides}
    folds |= {f"_run_{size}": ("sum", (boxed & F.col(size).isNotNull()).cast("bigint")) for _, size in sides}
    folds |= {
        "_s_label": ("last", F.when(good, F.col("label"))), "_s_frame": ("last", F.when(good, F.col("_frame"))),
        "_s_note": ("last", F.when(good & F.col("has_note"), F.struct(F.col("note").alias("v")))),
        "_bumps": ("sum", (good & F.col("op").isin("update", "delete")).cast("bigint")),
    }
    rows = hotkeys.scan(rows.drop("_s_time"), cut, ["seq"], folds | {"_s_time": ("last", F.when(good, F.col("_time")))})

    def room(corner: str, size: str) -> Column:
        left = 1.0 - F.when(F.col(corner).isNotNull(), inside(corner)).otherwise(F.col(f"_s_{corner}"))
        # A label-only edit leaves the box alone: it neither gives a size nor cuts one.
        return F.when(boxed, F.struct(F.col(f"_run_{size}").alias("run"), (-half_up(F.least(F.col(size), left), 6)).alias("less")))

    rows = hotkeys.scan(rows, cut, ["seq"], {f"_s_{size}": ("max", room(corner, size)) for corner, size in sides})
    is_box = F.col("kind") == "bbox"
    state = rows.select(
        "annotation_id", "seq", "op", "reason", "asset_id", F.col("a_dataset_id").alias("dataset_id"), "kind", F.col("_s_label").alias("label"),
        F.when(is_box, F.col("_s_x")).alias("x"), F.when(is_box, F.col("_s_y")).alias("y"),
        F.when(is_box, -F.col("_s_width.less")).alias("box_width"), F.when(is_box, -F.col("_s_height.less")).alias("box_height"),
        F.col("_s_frame.v").alias("frame_index"), F.col("_s_time").alias("timestamp_ms"),
        F.col("a_width").alias("width"), F.col("a_height").alias("height"), F.col("_s_note.v").alias("note"),
        F.col("_first._origin.created_by").alias("created_by"), F.col("_first._origin.created_at").alias("created_at"),
        (F.col("_first._origin.revision") + F.col("_bumps")).alias("revision"), "user_id", "at", "_ended",
    )
    state = hotkeys.previous_row(state, cut, ["seq"], list(_TRACKED_COLUMNS.values()), "_prev")
    diff = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_prev.{c}")), F.lit(name)) for name, c in _TRACKED_COLUMNS.items()])
    )
    changed = (
        F.when(F.col("op") == "create", F.array(*[F.lit(t) for t in TRACKED]))
        .when(F.col("op") == "update", diff)
        .otherwise(F.array().cast("array<string>"))
    )
    state = state.withColumn("changed_fields", changed).drop("_prev")
    asks = F.col("op") == "restore"
    here = F.col("annotation_id").isNotNull() & F.coalesce(F.col("_ended") < F.col("seq"), F.lit(False))
    version = F.when(F.col("reason").isNull() & _makes_version(), F.col("seq"))
    verdict = {
        "reason": F.when(asks, F.when(~here, F.lit(NOT_DELETED))).otherwise(F.col("reason")),
        "seen": F.when(asks & F.col("annotation_id").isNotNull(), F.col("seen")),
    }
    if cut.hot is not None:
        state = hotkeys.scan(state, cut, ["seq"], {"seen": ("min", version)}).withColumns(verdict).drop("_ended")
    else:
        # What is read below: the last state of an id, and what makes a version. Of a refused row the reason is enough.
        whole = cut.window(["seq"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        good = F.col("reason").isNull()
        state = state.withColumns({"seen": F.min(version).over(whole), "_last": F.max(F.when(good, F.col("seq"))).over(whole)})
        state = state.withColumns(verdict).drop("_ended")
        state = state.where(~good | asks | _makes_version() | (F.col("seq") >= F.col("_last"))).drop("_last")
        kept, asked = ("annotation_id", "seq", "op", "reason", "seen"), ("user_id", "at")
        state = state.select(
            *[c if c in kept else F.when(good | asks if c in asked else good, F.col(c)).alias(c) for c in state.columns]
        )
    return staged(state, "edited")


def _makes_version() -> Column:
    """Whether a row that is not refused changes an annotation's history."""
    return F.col("op").isin("create", "delete") | ((F.col("op") == "update") & (F.size("changed_fields") > 0))


# Why a restore is refused.
NOT_DELETED = "This annotation is not deleted; edit it instead"
NO_HISTORY = "No history for this annotation"

# The shape of ids that restores make.
NEW_KEY = "^[0-9a-f]{24}$"


def new_key(old_id: Column, seq: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0001", old_id, seq.cast("string"), F.lit("restore")), 256), 1, 24)


@dataclass(frozen=True)
class _Pass:
    untouched: DataFrame
    kept: DataFrame
    restored: DataFrame
    versions: DataFrame
    restore_versions: DataFrame
    rejects: DataFrame


def _apply_once(
    annotations: DataFrame, versions: DataFrame, log: DataFrame, assets: DataFrame, classes: DataFrame, limit: int
) -> _Pass:
    """Apply a log that names no id which it restores itself."""
    state = _folded(annotations, log, assets, classes, limit)
    asks = F.col("op") == "restore"
    done = state.where(F.col("reason").isNull() & ~asks)
    logged = done.where(_makes_version())
    none = F.lit(None).cast("bigint")

    def history(source: DataFrame, change_type: Column, restored_from: Column) -> DataFrame:
        return source.select(
            "annotation_id", "asset_id", "dataset_id", "revision", F.struct(*SNAPSHOT).alias("snapshot"),
            "changed_fields", change_type.alias("change_type"), restored_from.alias("restored_from"),
            F.col("user_id").alias("changed_by"), F.col("at").alias("created_at"),
        )

    new_versions = history(logged, F.col("op"), none)

    # --- Live rows after the log: the last state of each touched id, unless deleted.
    final = done.groupBy("annotation_id").agg(
        F.max_by(F.struct(*[c for c in state.columns if c != "annotation_id"]), "seq").alias("s")
    )
    touched = final.select("annotation_id", "s.*")
    live = touched.where(F.col("op") != "delete").select(
        "annotation_id", "asset_id", "dataset_id", "kind", "label", "x", "y", "box_width", "box_height",
        "frame_index", "timestamp_ms", "width", "height", "note", "revision", "created_by",
        F.col("user_id").alias("updated_by"), "created_at", F.col("at").alias("updated_at"),
    )
    untouched = annotations.join(done.select("annotation_id").distinct(), "annotation_id", "left_anti")

    # --- Restores: of ids deleted earlier in the log, or before it.
    none_changed = F.array().cast("array<string>").alias("changed_fields")
    made = [new_key(F.col("annotation_id"), F.col("seq")).alias("annotation_id"), F.lit(1).cast("bigint").alias("revision")]
    back = state.where(asks & F.col("reason").isNull()).select(*made, F.col("revision").alias("_rev"), *SNAPSHOT, "user_id", "at", none_changed)
    refused = state.where(asks & F.col("reason").isNotNull()).select("annotation_id", "seq", "user_id", "at", "seen")
    if not versions.isEmpty():
        # Only the history of ids that are asked for is moved.
        past = versions.join(broadcast_if_small(refused.select("annotation_id")), "annotation_id", "left_semi").groupBy("annotation_id")
        past = past.agg(F.max_by(F.struct("revision", "snapshot", "change_type"), "revision").alias("_v"))
        # An id is deleted once at most in a log.
        here = logged.where(F.col("op") == "delete").select("annotation_id", F.lit(True).alias("_here"))
        refused = refused.join(past, "annotation_id", "left").join(here, "annotation_id", "left")
        gone = (F.col("_v.change_type") == "delete") & F.col("_here").isNull() & (F.col("seq") > -1)
        refused = refused.withColumns(
            {"_ok": F.coalesce(gone, F.lit(False)), "seen": F.when(F.col("_v").isNotNull(), F.least("seen", F.lit(-1).cast("bigint"))).otherwise(F.col("seen"))}
        )
        old = refused.where("_ok").select(*made, F.col("_v.revision").alias("_rev"), "_v.snapshot.*", "user_id", "at", none_changed)
        back, refused = back.unionByName(old), refused.where("NOT _ok")
    refusal = F.when(F.coalesce(F.col("seen") > F.col("seq"), F.lit(True)), NO_HISTORY).otherwise(NOT_DELETED)
    bad_restores = refused.select("annotation_id", "seq", refusal.alias("reason"))
    restored = back.select(
        "annotation_id", "asset_id", "dataset_id", "kind", "label", "x", "y", "box_width", "box_height",
        "frame_index", "timestamp_ms", "width", "height", "note", "revision",
        F.col("user_id").alias("created_by"), F.col("user_id").alias("updated_by"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )
    rejects = state.where(F.col("reason").isNotNull() & ~asks).select("annotation_id", "seq", "reason").unionByName(bad_restores)
    return _Pass(untouched, live, restored, new_versions, history(back, F.lit("restore"), F.col("_rev")), rejects)


def apply_annotation_edits(
    annotations: DataFrame, versions: DataFrame, log: DataFrame, assets: DataFrame, classes: DataFrame,
    limit: int = hotkeys.KEY_ROW_LIMIT,
) -> Edits:
    """Apply the log in ``seq`` order to live annotations and their history."""
    if "has_frame" not in log.columns:
        log = log.withColumn("has_frame", F.lit(False))
    # A vocabulary, measured several times below.
    classes = staged(classes, "classes")
    live, new_versions, refused = [], [], []
    while True:
        # Rows that name an id which an earlier restore would make wait for it. Logs seldom have such rows.
        born = log.where(F.col("op") == "restore").select(
            new_key(F.col("annotation_id"), F.col("seq")).alias("annotation_id"), F.col("seq").alias("_born")
        )
        candidates = log.where(F.col("annotation_id").rlike(NEW_KEY))
        waiting = candidates.join(born, "annotation_id").where(F.col("seq") > F.col("_born")).drop("_born")
        more = not candidates.isEmpty() and not waiting.isEmpty()
        if more:
            waiting = staged(waiting, "waiting")
            log = log.join(waiting.select("annotation_id", "seq"), ["annotation_id", "seq"], "left_anti")
        step = _apply_once(annotations, versions, log, assets, classes, limit)
        live += [step.untouched, step.kept]
        new_versions += [step.versions, step.restore_versions]
        refused.append(step.rejects)
        if not more:
            break
        annotations, versions, log = staged(step.restored, "restored"), staged(step.restore_versions, "restored"), waiting
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Edits(union([*live, step.restored]), union(new_versions), union(refused))
