import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelmill.operators import history, updates
from labelmill.schemas import TABLES, empty, table_type

T0 = datetime(2026, 2, 1)


def comment(i, sentiment="unannotated", type_="unclassified", status="pending", text="t", dataset="d", version=1, note=None):
    return (i, dataset, i, text, sentiment, type_, status, None, None, None, None, None, note, version, "u0", "u0", T0, T0)


@pytest.fixture(scope="module")
def options(spark):
    return spark.createDataFrame(
        [("d", ["positive", "negative", "neutral", "unannotated"], ["bangla", "english", "banglish", "unclassified"])],
        "dataset_id string, sentiments array<string>, types array<string>",
    )


PATCH = "comment_id string, seq long, sentiment string, type string, note string, has_note boolean, user_id string, at timestamp"


def fold_in_turn(comments, patches):
    state = {c[0]: dict(sentiment=c[4], type=c[5], status=c[6], note=c[12], version=c[13]) for c in comments}
    versions, rejects = [], []
    allowed = {"sentiment": {"positive", "negative", "neutral", "unannotated"}, "type": {"bangla", "english", "banglish", "unclassified"}}
    for cid, seq, s, t, note, has_note, user, at in sorted(patches, key=lambda p: p[1]):
        if cid not in state:
            rejects.append((cid, seq, "Comment not found"))
            continue
        if s is not None and s not in allowed["sentiment"]:
            rejects.append((cid, seq, "Invalid sentiment value"))
            continue
        if t is not None and t not in allowed["type"]:
            rejects.append((cid, seq, "Invalid type value"))
            continue
        c, changed = state[cid], []
        for field, name, value, given in (("sentiment", "sentiment", s, s is not None), ("type", "type", t, t is not None), ("note", "annotationNote", note, has_note)):
            if given and value != c[field]:
                c[field] = value
                changed.append(name)
        if not changed:
            continue
        status = "pending" if c["sentiment"] == "unannotated" or c["type"] == "unclassified" else "annotated"
        if status != c["status"]:
            changed.append("status")
        c["status"] = status
        c["version"] += 1
        versions.append((cid, c["version"], c["sentiment"], c["type"], status, c["note"], tuple(changed), user))
    return state, versions, rejects


@pytest.mark.parametrize("limit", [5, 10**6])
def test_fold_equals_patching_in_turn(spark, options, limit):
    rng = random.Random(3)
    comments = [comment(str(i), status=rng.choice(["pending", "annotated"])) for i in range(12)]
    patches = []
    for seq in range(400):
        cid = rng.choice(["0"] * 10 + [str(i) for i in range(13)])
        patches.append(
            (cid, seq, rng.choice([None, "positive", "negative", "unannotated", "odd"]),
             rng.choice([None, None, "english", "unclassified", "klingon"]), rng.choice([None, "n1", "n2"]),
             rng.random() < 0.3, rng.choice(["u1", "u2"]), T0 + timedelta(seconds=seq))
        )
    changes = history.apply_annotations(
        spark.createDataFrame(comments, table_type("comments")), spark.createDataFrame(patches, PATCH), options, limit=limit
    )
    state, versions, rejects = fold_in_turn(comments, patches)
    got = changes.versions.select("comment_id", "version", "snapshot.*", "changed_fields", "changed_by").collect()
    assert sorted(map(str, [(r.comment_id, r.version, r.sentiment, r.type, r.status, r.note, tuple(r.changed_fields), r.changed_by) for r in got])) == sorted(map(str, versions))
    assert sorted(map(tuple, changes.rejects.collect())) == sorted(rejects)
    after = {r.comment_id: (r.sentiment, r.type, r.status, r.note, r.version) for r in changes.comments.collect()}
    assert after == {k: (s["sentiment"], s["type"], s["status"], s["note"], s["version"]) for k, s in state.items()}
    per = {}
    for v in versions:
        per.setdefault(v[0], []).append(v[1])
    assert all(sorted(v) == list(range(2, len(v) + 2)) for v in per.values())


@pytest.mark.parametrize("limit", [3, 10**6])
def test_text_edits_and_restore(spark, limit):
    comments = spark.createDataFrame([comment("a", text="one"), comment("b", text="two", note="n")], table_type("comments"))
    edits = [("a", i, f" edit {i} ", "u1", T0 + timedelta(seconds=i)) for i in range(1, 10)]
    edits += [("a", 10, "", "u1", T0), ("zz", 11, "x", "u1", T0)]
    changes = history.apply_text_edits(
        comments, spark.createDataFrame(edits, "comment_id string, seq long, text string, user_id string, at timestamp"), limit
    )
    rows = changes.versions.orderBy("version").collect()
    assert [(r.version, r.snapshot.text) for r in rows] == [(i + 1, f"edit {i}") for i in range(1, 10)]
    assert sorted(r.reason for r in changes.rejects.collect()) == ["Comment not found", "commentText is required"]
    assert {r.comment_id: (r.text, r.version) for r in changes.comments.collect()} == {"a": ("edit 9", 10), "b": ("two", 1)}

    asked = spark.createDataFrame([("a", 3, "u9", T0), ("b", 7, "u9", T0), ("q", 1, "u9", T0)], "comment_id string, version long, user_id string, at timestamp")
    back = history.restore_versions(changes.comments, changes.versions, asked)
    v = back.versions.first()
    assert (v.version, v.restored_from, v.change_type, v.changed_fields, v.snapshot.text) == (11, 3, "restore", ["restore"], "edit 2")
    assert sorted(r.reason for r in back.rejects.collect()) == ["Comment not found", "Version not found"]
    row = back.comments.where("comment_id = 'a'").first()
    assert (row.text, row.version, row.updated_by, row.annotated_by) == ("edit 2", 11, "u9", None)

    times = [("a", v, "u9", T0 + timedelta(seconds=s)) for s, v in ((2, 4), (1, 3), (3, 3), (4, 6))]
    asked = spark.createDataFrame(times, "comment_id string, version long, user_id string, at timestamp")
    back = history.restore_versions(changes.comments, changes.versions, asked, limit)
    made = back.versions.orderBy("version").collect()
    assert [(r.version, r.restored_from) for r in made] == [(11, 3), (12, 4), (13, 3), (14, 6)]
    row = back.comments.where("comment_id = 'a'").first()
    assert (row.text, row.version) == ("edit 5", 14)


def test_state_and_history(spark):
    rows = [("a", i, (f"t{i}", "positive", "x", "pending", None, None, None, None), [], "update", None, "u", T0 + timedelta(days=i)) for i in range(1, 6)]
    versions = spark.createDataFrame(rows, table_type("comment_versions"))
    assert history.state_as_of(versions).first().snapshot.text == "t5"
    assert history.state_as_of(versions, version=3).first().snapshot.text == "t3"
    assert history.state_as_of(versions, at=T0 + timedelta(days=2)).first().version == 2
    assert [r.version for r in history.version_history(versions, "a", page=2, limit=2).collect()] == [3, 2]
    diff = history.version_diff(versions, ["text", "sentiment"]).orderBy("version").collect()
    assert [r.changed_fields for r in diff] == [["text", "sentiment"]] + [["text"]] * 4
    assert updates.append_versions(empty(spark, "comment_versions"), versions).count() == 5


def test_insert_new_and_null_keys(spark):
    existing = spark.createDataFrame([("A", "r1")], "dataset_id string, source_id string")
    incoming = spark.createDataFrame(
        [("A", "r1", 0), ("A", "r5", 1), ("A", "r5", 2), ("A", None, 3), ("A", None, 4)], "dataset_id string, source_id string, row int"
    )
    kept, clashes = updates.insert_new(existing, incoming, ["dataset_id", "source_id"], "row")
    assert sorted(r.row for r in kept.collect()) == [1, 3, 4] and sorted(r.row for r in clashes.collect()) == [0, 2]


def test_upsert_sets_nulls_and_refuses_identity(spark):
    base = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "id string, name string, other string")
    patch = spark.createDataFrame([("a", None)], "id string, name string")
    got = {r.id: (r.name, r.other, r.modified) for r in updates.upsert(base, patch, "id", ["name"], T0).collect()}
    assert got == {"a": (None, "y", True), "b": ("x", "y", False)}
    with pytest.raises(ValueError):
        updates.upsert(base, patch, "id", ["id"], T0)


def test_upsert_takes_the_last_of_several_patches(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, name string")
    patch = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), ("a", "y", 2)], "id string, name string, n int")
    got = sorted((r.id, r.name) for r in updates.upsert(base, patch, "id", ["name"], T0, order="n").collect())
    assert got == [("a", "y"), ("b", "x")]
    assert sorted((r.id, r.name) for r in updates.upsert(base, patch, "id", ["name"], T0).collect()) == [("a", "z"), ("b", "x")]


def test_assign_and_expire(spark):
    rows = spark.createDataFrame([comment("a"), comment("b")], table_type("comments"))
    users = spark.createDataFrame([("u1", True), ("u2", False)], "user_id string, is_active boolean")
    ids = spark.createDataFrame([("a",)], "comment_id string")
    got = {r.comment_id: (r.assigned_to, r.assigned_at, r.assigned_by) for r in updates.bulk_assign(rows, ids, "comment_id", "u1", "adm", T0, users).collect()}
    assert got == {"a": ("u1", T0, "adm"), "b": (None, None, None)}
    off = updates.bulk_assign(rows, ids, "comment_id", None, "adm", T0).where("comment_id = 'a'").first()
    assert (off.assigned_to, off.assigned_at, off.assigned_by) == (None, None, "adm")
    with pytest.raises(ValueError):
        updates.bulk_assign(rows, ids, "comment_id", "u2", "adm", T0, users)
    sets = spark.createDataFrame([("d1", "pending", T0, None), ("d2", "processing", T0 + timedelta(hours=1), None), ("d3", "completed", T0, None)], "dataset_id string, status string, updated_at timestamp, import_error string")
    done = {r.dataset_id: r.status for r in updates.expire_stale_imports(sets, T0 + timedelta(minutes=30), T0 + timedelta(hours=2)).collect()}
    assert done == {"d1": "failed", "d2": "processing", "d3": "completed"}


def test_cascade_and_copy(spark):
    comments = spark.createDataFrame([comment("a", dataset="A"), comment("b", dataset="A"), comment("c", dataset="B")], table_type("comments"))
    snap = ("t", "positive", "x", "pending", None, None, None, None)
    versions = spark.createDataFrame([(i, n, snap, [], "update", None, "u", T0) for i in "abc" for n in (1, 2)], table_type("comment_versions"))
    gone = spark.createDataFrame([("A",)], "dataset_id string")
    left = updates.delete_cascade({"comments": comments, "versions": versions}, gone, "dataset_id", [("comments", "dataset_id", ""), ("versions", "comment_id", "comments")], {"comments": "comment_id"})
    assert [r.comment_id for r in left["comments"].collect()] == ["c"] and left["versions"].count() == 2
    copied, log = updates.duplicate_dataset(comments, versions, "A", "A2", "me", T0)
    ids = {r.comment_id for r in copied.collect()}
    assert len(ids) == 2 and not ids & {"a", "b"} and {r.comment_id for r in log.collect()} == ids and log.count() == 4
    assert set(copied.columns) == set(table_type("comments").names)
    assert TABLES["comments"]


def test_cascade_uses_the_named_keys(spark):
    annotations = spark.createDataFrame([("D", "a1", "n1"), ("D", "a2", "n2")], "dataset_id string, asset_id string, annotation_id string")
    versions = spark.createDataFrame([("n1", 1), ("n1", 2), ("n2", 1)], "annotation_id string, revision int")
    gone = spark.createDataFrame([("a1",)], "asset_id string")
    children = [("annotations", "asset_id", ""), ("versions", "annotation_id", "annotations")]
    tables = {"annotations": annotations, "versions": versions}
    left = updates.delete_cascade(tables, gone, "asset_id", children, {"annotations": "annotation_id"})
    assert [r.annotation_id for r in left["annotations"].collect()] == ["n2"]
    assert [r.annotation_id for r in left["versions"].collect()] == ["n2"]
    with pytest.raises(ValueError):
        updates.delete_cascade(tables, gone, "asset_id", children, {"annotations": "id"})
