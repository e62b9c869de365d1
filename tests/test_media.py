import hashlib
import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelmill.operators import media, media_edits, vocabulary
from labelmill.operators.media_edits import TRACKED, apply_annotation_edits
from labelmill.schemas import empty, table_type

T0 = datetime(2026, 2, 1)


def r6(v):
    return math.floor(v * 1e6 + 0.5) / 1e6


def iou(a, b):
    ow = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    oh = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if ow <= 0 or oh <= 0:
        return 0
    shared = ow * oh
    union = r6(a[2] * a[3]) + r6(b[2] * b[3]) - shared
    return r6(shared / union) if union > 0 else 0


def box_row(i, asset, box, frame=None, kind="bbox", label="car", created=T0):
    x, y, w, h = box if kind == "bbox" else (None,) * 4
    return (i, asset, "D", kind, label, x, y, w, h, frame, None, 800, 600, None, 1, "u", "u", created, created)


def boxes_df(spark, rows):
    return spark.createDataFrame(rows, table_type("media_annotations"))


@pytest.mark.parametrize("min_iou", [0.05, 0.3, 0.5, 0.9, 1.0])
def test_overlaps_equal_all_pairs(spark, min_iou):
    rng = random.Random(int(min_iou * 100))
    rows, n = [], 0
    for asset in ("a", "b"):
        for frame in (None, 1):
            placed = []
            for _ in range(60):
                if placed and rng.random() < 0.4:
                    x, y, w, h = rng.choice(placed)
                    f = rng.choice([0, 0.001, 0.02, 0.1])
                    box = (r6(x + rng.uniform(-f, f) * w), r6(y + rng.uniform(-f, f) * h), r6(w * (1 + rng.uniform(-f, f))), r6(h * (1 + rng.uniform(-f, f))))
                else:
                    w, h = 10 ** rng.uniform(-3.5, 0), 10 ** rng.uniform(-3.5, 0)
                    box = (r6(rng.uniform(0, 1 - w)), r6(rng.uniform(0, 1 - h)), r6(w), r6(h))
                if min(box) < 0 or box[2] == 0 or box[3] == 0:
                    continue
                placed.append(box)
                rows.append(box_row(f"n{n:04d}", asset, box, frame))
                n += 1
    want = {}
    folded = {}
    for r in rows:
        folded.setdefault((r[1], r[9], r[5:9]), []).append(r[0])
    members = [(k[0], k[1], k[2], min(v), len(v)) for k, v in folded.items()]
    for p, q in itertools.combinations(members, 2):
        if p[:2] == q[:2] and iou(p[2], q[2]) >= min_iou:
            want[(p[0], p[1], *sorted((p[3], q[3])))] = (iou(p[2], q[2]), p[4] * q[4])
    for m in members:
        if m[4] > 1 and iou(m[2], m[2]) >= min_iou:
            want[(m[0], m[1], m[3], m[3])] = (iou(m[2], m[2]), m[4] * (m[4] - 1) // 2)
    rows.append(box_row("zz", "a", (0, 0, 1, 1), kind="classification"))
    got = media.overlap_pairs(boxes_df(spark, rows), min_iou).collect()
    assert len(got) == len({(r.asset_id, r.frame_index, r.first_id, r.second_id) for r in got})
    assert {(r.asset_id, r.frame_index, r.first_id, r.second_id): (r.iou, r.pairs) for r in got} == want and want


def test_overlap_of_very_many_copies_is_one_row(spark):
    many = boxes_df(spark, [box_row("a", "x", (0.1, 0.1, 0.5, 0.5))]).crossJoin(spark.range(2000)).withColumn(
        "annotation_id", F.format_string("%05d", "id")
    ).drop("id")
    row = media.overlap_pairs(many, 0.5).collect()
    assert [(r.first_id, r.second_id, r.pairs) for r in row] == [("00000", "00000", 2000 * 1999 // 2)]


def test_crowded_frames_equal_ordinary_ones(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        x, y = rng.random() * 0.9, rng.random() * 0.9
        rows.append(box_row(f"{i:04}", rng.choice("ab"), (r6(x), r6(y), r6(rng.random() * (1 - x)), r6(rng.random() * (1 - y)))))
    boxes = boxes_df(spark, rows)
    for least in (0.002, 0.3):
        want = sorted(map(tuple, media.overlap_pairs(boxes, least).collect()))
        assert sorted(map(tuple, media.overlap_pairs(boxes, least, plain_boxes=10).collect())) == want and want


def test_crowded_cells_equal_ordinary_ones(spark):
    rng, rows = random.Random(9), []
    for i in range(240):
        if i % 3 == 0:  # of one size, close together: one cell of a size class
            x, y, w, h = 0.3 + rng.random() * 0.02, 0.3 + rng.random() * 0.02, 0.2 + rng.random() * 0.01, 0.2
        elif i % 3 == 1:  # small ones spread over one small cell
            x, y, w, h = 0.502 + rng.random() * 0.004, 0.502 + rng.random() * 0.004, 0.002 + rng.random() * 0.002, 0.003
        else:  # small ones all in the same place
            x, y, w, h = 0.7, 0.7 + rng.random() * 1e-5, 0.001 + rng.random() * 0.0005, 0.0011
        rows.append(box_row(f"{i:04}", "a", (r6(x), r6(y), r6(w), r6(h))))
    boxes = boxes_df(spark, rows)
    for least in (0.1, 0.6):
        want = sorted(map(tuple, media.overlap_pairs(boxes, least).collect()))
        got = sorted(map(tuple, media.overlap_pairs(boxes, least, plain_boxes=10, cell_boxes=7).collect()))
        assert got == want and len(want) > 100


def test_a_hundred_thousand_boxes_of_one_cell(spark):
    side = 316
    at = lambda n: F.round(0.0002 + n * 3e-5, 6)
    boxes = spark.range(side * side).select(
        F.format_string("%06d", "id").alias("annotation_id"), F.lit("a").alias("asset_id"), F.lit("bbox").alias("kind"),
        F.lit(None).cast("bigint").alias("frame_index"), at(F.col("id") % side).alias("x"), at(F.floor(F.col("id") / side)).alias("y"),
        F.lit(4e-5).alias("box_width"), F.lit(2e-5).alias("box_height"),
    )
    cells = media._small_cells(
        media._distinct_boxes(boxes).withColumns({"right": F.col("x") + F.col("box_width"), "bottom": F.col("y") + F.col("box_height")}), 500
    )
    counts = cells.groupBy("ky", "gx", "gy").count().agg(F.max("count"), F.count("*")).first()
    assert counts[0] <= 500 and counts[1] >= 200
    # Areas are rounded to six places, so boxes as small as these have none and no share of one another.
    assert media.overlap_pairs(boxes, 0.1, cell_boxes=500).count() == 0


def test_checksum_copies_leave_out_unknown_checksums(spark):
    rows = [("a", "D", None, T0), ("b", "D", None, T0), ("c", "D", "x", T0), ("d", "D", "x", T0)]
    assets = spark.createDataFrame(rows, "asset_id string, dataset_id string, checksum string, created_at timestamp")
    assert [r.asset_id for r in media.checksum_duplicates(assets).collect()] == ["d"]


def test_recent_work_honours_n(spark):
    rows = [(f"{i:03}", "u", T0) for i in range(250)]
    work = spark.createDataFrame(rows, "annotation_id string, created_by string, created_at timestamp")
    assert media.recent_work_by_user(work, 200).count() == 200
    with pytest.raises(ValueError):
        media.recent_work_by_user(work, 0)


SCENE_LABELS = [("car", "Car", "#ff0000"), ("person", "Person", "#00ff00")]


@pytest.fixture(scope="module")
def scene(spark):
    assets = [
        ("a", "C", "image", "a.png", "png", None, 1234, "abc123", 800, 600, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0),
        ("b", "C", "video", "b.mp4", "mp4", None, 99999, "def456", None, None, 65000, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0),
    ]
    annotations = [
        ("1", "a", "C", "bbox", "car", 0.125, 0.25, 0.5, 0.375, None, None, 800, 600, None, 1, "u", "u", T0, T0),
        ("2", "a", "C", "classification", "person", None, None, None, None, None, None, 800, 600, None, 1, "u", "u", T0, T0),
        ("3", "b", "C", "bbox", "car", 0.0, 0.0, 1.0, 1.0, 30, 1000, None, None, None, 1, "u", "u", T0, T0),
    ]
    a = spark.createDataFrame(assets, table_type("media_assets"))
    n = spark.createDataFrame(annotations, table_type("media_annotations"))
    sets = spark.createDataFrame([("L", "Road", SCENE_LABELS)], "label_set_id string, name string, labels array<struct<value:string,label:string,color:string>>")
    data = spark.createDataFrame([("C", "City", "L")], "dataset_id string, name string, label_set_id string")
    return a, n, vocabulary.class_list(data, sets), data


def test_scene_counts(scene):
    assets, annotations, classes, data = scene
    assert media.label_histogram(annotations).first()["count"] == 2
    assert {r.label: r["count"] for r in media.label_counts(annotations).collect()} == {"car": 2, "person": 1}
    fresh = media.refresh_asset_state(assets, annotations)
    counters = media.refresh_dataset_counters(data, fresh, annotations).first()
    assert (counters.total_assets, counters.annotated_assets, counters.total_annotations, counters.total_bytes, counters.annotated_ratio) == (2, 2, 3, 101233, 1.0)
    stats = media.dataset_stats(data, fresh, annotations).first()
    assert (stats.total_boxes, stats.class_balance, stats.video) == (2, 0.0, 1)
    assert [r.asset_id for r in media.exportable_assets(fresh, kind="image").collect()] == ["a"]
    assert media.exportable_assets(assets).count() == 0


def test_labels_resolve_by_value_then_text(spark, scene):
    rows = spark.createDataFrame([("C", v) for v in ("car", " CAR ", "Person", "", "dog", None)], "dataset_id string, label string")
    got = [(r.value, r.label_error) for r in vocabulary.resolve_labels(rows, scene[2]).orderBy("label").collect()]
    by = {r.label: (r.value, r.label_error) for r in vocabulary.resolve_labels(rows, scene[2]).collect()}
    assert by["car"] == ("car", None) and by[" CAR "] == ("car", None) and by["Person"] == ("person", None)
    assert by[""][1] == by[None][1] == "A label is required" and "is not a label" in by["dog"][1] and len(got) == 6


def test_label_list_problems(spark):
    schema = "label_set_id string, idx int, label string, value string, color string"
    rows = [("ok", 0, "Café", None, None), ("ok", 1, "Big Dog", "dog", "#1"), ("dup", 0, "A b", None, None), ("dup", 1, "a-B", None, None),
            ("empty", 0, "  ", None, None), ("long", 0, "x" * 65, None, None), ("odd", 0, "日本", None, None)]
    rows += [("many", i, f"l{i}", None, None) for i in range(201)]
    items = spark.createDataFrame(rows, schema)
    got = {r.label_set_id: (r.labels, r.error) for r in vocabulary.normalize_classes(items, max_classes=200, max_chars=64).collect()}
    assert [tuple(v) for v in got["ok"][0]] == [("cafe", "Café", "hsl(0, 65%, 55%)"), ("dog", "Big Dog", "#1")]
    assert got["dup"][1].startswith('Duplicate class name "a_b"') and got["empty"][1] == "Label 1 is empty"
    free = {r.label_set_id: r for r in vocabulary.normalize_classes(items).collect()}
    assert len(free["many"].labels) == 201 and free["long"].labels[0].value == "x" * 65
    assert "exceeds 64" in got["long"][1] and "no usable characters" in got["odd"][1] and "at most 200" in got["many"][1]


def test_term_list_problems(spark):
    schema = "taxonomy_id string, axis string, idx int, label string, value string, order double"
    rows = [("ok", "sentiment", 0, " Good ", None, 5.0), ("ok", "sentiment", 1, "Bad", "very bad", 1.0), ("ok", "type", 0, "None", "unclassified", None),
            ("no", "type", 0, "", None, None), ("no", "sentiment", 0, "a", "!!", None), ("dup", "type", 0, "a", None, None), ("dup", "type", 1, "A", None, None)]
    rows += [("many", "type", i, f"t{i}", None, None) for i in range(51)]
    items = spark.createDataFrame(rows, schema)
    got = {(r.taxonomy_id, r.axis): (r.terms, r.error) for r in vocabulary.normalize_terms(items, max_terms=50).collect()}
    assert len([r for r in vocabulary.normalize_terms(items).collect() if r.taxonomy_id == "many"][0].terms) == 52
    assert [t.value for t in got["ok", "sentiment"][0]] == ["very_bad", "good", "unannotated"]
    assert [t.value for t in got["ok", "type"][0]] == ["unclassified"]
    assert got["no", "type"][1] == "type[0].label is required" and "could not be derived" in got["no", "sentiment"][1]
    assert got["dup", "type"][1] == 'type has duplicate value "a"' and "more than 50" in got["many", "type"][1]


# --- The edit log -----------------------------------------------------------

LOG = (
    "seq long, op string, annotation_id string, asset_id string, kind string, label string, x double, y double, "
    "width double, height double, pixel boolean, frame_index double, timestamp_ms double, note string, "
    "has_note boolean, user_id string, at timestamp, has_frame boolean"
)
NAMES = [c.split()[0] for c in LOG.split(", ")]


class Refused(Exception):
    pass


def restored_id(old, seq):
    return hashlib.sha256(f"{old}\x01{seq}\x01restore".encode()).hexdigest()[:24]


def edit_in_turn(live, log, assets):
    """The rules, one edit at a time. Returns (live, versions, rejects)."""
    labels = {"car": "car", "person": "person", "Car": "car", "PERSON": "person"}
    live = {k: dict(v) for k, v in live.items()}
    versions, rejects, deleted = [], [], {}

    def resolve(label):
        if not (label or "").strip():
            raise Refused("A label is required")
        if label.strip() not in labels:
            raise Refused(f'"{label.strip()}" is not a label in this dataset\'s label set')
        return labels[label.strip()]

    def normal(x, y, w, h):
        if any(v is None or not math.isfinite(v) for v in (x, y, w, h)):
            raise Refused("Box requires numeric x, y, width and height")
        if w <= 0 or h <= 0:
            raise Refused("Box width and height must be greater than zero")
        left, top = min(max(x, 0), 1), min(max(y, 0), 1)
        w, h = min(w, 1 - left), min(h, 1 - top)
        if w <= 0 or h <= 0:
            raise Refused("Box lies entirely outside the image")
        return r6(left), r6(top), r6(w), r6(h)

    def frame(f, ms, duration):
        if ms is not None:
            if ms < 0:
                raise Refused("timestampMs must be zero or greater")
            if duration and ms > duration:
                raise Refused("Frame timestamp is beyond the end of the video")
            ms = math.floor(ms + 0.5)
        if f is not None:
            if f < 0:
                raise Refused("frameIndex must be zero or greater")
            if ms is None and duration is None:
                raise Refused("frameIndex needs a known video duration; send timestampMs instead")
            f = int(f)
        return f, ms

    fields = dict(zip(TRACKED, ("label", "kind", "note", "x", "y", "w", "h", "frame", "ms")))
    for row in log:
        e = dict(zip(NAMES, row))
        cid, sides = e["annotation_id"], [e[s] for s in ("x", "y", "width", "height")]
        given = any(s is not None for s in sides)
        try:
            if e["op"] == "restore":
                if cid not in deleted:
                    raise Refused("This annotation is not deleted; edit it instead" if any(v[0] == cid for v in versions) else "No history for this annotation")
                rev, snap = deleted[cid]
                live[restored_id(cid, e["seq"])] = dict(snap, rev=1, by=e["user_id"])
                versions.append((restored_id(cid, e["seq"]), 1, "restore", (), rev))
                continue
            if e["op"] == "create":
                if cid in live or any(v[0] == cid for v in versions):
                    raise Refused("Annotation already exists")
                a = assets[e["asset_id"]]
                kind = e["kind"] or "bbox"
                made = dict(asset=e["asset_id"], kind=kind, label=resolve(e["label"]), note=e["note"], x=None, y=None, w=None, h=None, frame=None, ms=None, rev=1, by=e["user_id"])
                if kind == "bbox":
                    if not given:
                        raise Refused("A bbox annotation requires a box")
                    if e["pixel"]:
                        if not a["width"]:
                            raise Refused("This image's dimensions are unknown, so a pixel box cannot be converted.")
                        if any(s is None for s in sides):
                            raise Refused("A pixel box needs x, y, width and height")
                        sides = [s / d for s, d in zip(sides, (a["width"], a["height"]) * 2)]
                    box = normal(*sides)
                    if a["kind"] == "video":
                        made["frame"], made["ms"] = frame(e["frame_index"], e["timestamp_ms"], a["duration"])
                    made["x"], made["y"], made["w"], made["h"] = box
                live[cid] = made
                versions.append((cid, 1, "create", TRACKED, None))
                continue
            if cid not in live:
                raise Refused("Annotation not found")
            old = live[cid]
            if e["op"] == "delete":
                versions.append((cid, old["rev"] + 1, "delete", (), None))
                deleted[cid] = (old["rev"] + 1, old)
                del live[cid]
                continue
            new, a = dict(old), assets[old["asset"]]
            if e["label"] is not None:
                new["label"] = resolve(e["label"])
            if e["has_note"]:
                new["note"] = e["note"]
            if old["kind"] == "bbox":
                if given:
                    if e["pixel"]:
                        if not a["width"]:
                            raise Refused("This image's dimensions are unknown, so a pixel box cannot be converted.")
                        if any(s is None for s in sides):
                            raise Refused("A pixel box needs x, y, width and height")
                        sides = [s / d for s, d in zip(sides, (a["width"], a["height"]) * 2)]
                    sides = [s if s is not None else old[k] for s, k in zip(sides, "xywh")]
                    new["x"], new["y"], new["w"], new["h"] = normal(*sides)
                if (e["frame_index"] is not None or e["timestamp_ms"] is not None or e["has_frame"]) and a["kind"] == "video":
                    f = e["frame_index"] if e["frame_index"] is not None or e["has_frame"] else old["frame"]
                    ms = e["timestamp_ms"] if e["timestamp_ms"] is not None else old["ms"]
                    new["frame"], new["ms"] = frame(f, ms, a["duration"])
            new["rev"] += 1
            changed = tuple(t for t, k in fields.items() if old[k] != new[k])
            live[cid] = new
            if changed:
                versions.append((cid, new["rev"], "update", changed, None))
        except Refused as no:
            rejects.append((cid, e["seq"], str(no)))
    return live, versions, rejects


@pytest.mark.parametrize("seed,limit", [(1, 10**6), (2, 4), (3, 10**6)])
def test_edit_log_equals_editing_in_turn(spark, seed, limit):
    rng = random.Random(seed)
    assets = {
        "img": dict(kind="image", width=800, height=600, duration=None), "raw": dict(kind="image", width=None, height=None, duration=None),
        "vid": dict(kind="video", width=640, height=480, duration=5000), "mkv": dict(kind="video", width=640, height=480, duration=None),
    }
    asset_rows = [
        (k, "C", a["kind"], k, "x", None, 1, k, a["width"], a["height"], a["duration"], "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0)
        for k, a in assets.items()
    ]
    start, rows = {}, []
    for i, asset in enumerate(["img", "vid", "mkv", "raw"]):
        kind = "classification" if asset == "raw" else "bbox"
        b = (0.1, 0.2, 0.3, 0.4) if kind == "bbox" else (None,) * 4
        start[f"old{i}"] = dict(asset=asset, kind=kind, label="car", note=None, x=b[0], y=b[1], w=b[2], h=b[3], frame=None, ms=None, rev=3, by="u")
        rows.append((f"old{i}", asset, "C", kind, "car", *b, None, None, assets[asset]["width"], assets[asset]["height"], None, 3, "u", "u", T0, T0))
    side = lambda: rng.choice([None, None, 0.05, 0.3, 0.7, 0.95, 1.0, -0.2, 1.3, rng.random()])
    size = lambda: rng.choice([None, None, None, 0.2, 0.6, 2.0, rng.random(), 0.0])
    log = []
    ids = ["old0", "old1", "old2", "old3", "new0", "new1", "new2", "new3"]
    for seq in range(300):
        op = rng.choices(["create", "update", "delete", "restore"], [3, 20, 2 if seq > 60 else 0.05, 2])[0]
        pixel = rng.random() < 0.2
        box = [side(), side(), size(), size()]
        if rng.random() < 0.3:
            box = [None] * 4
        if op == "create" and rng.random() < 0.7:
            box = [0.1, 0.2, 0.5, 0.5]
        if pixel:
            box = [v if v is None else v * 640 for v in box]
            if rng.random() < 0.6 and any(v is not None for v in box):
                box = [64.0, 48.0, 300.0, 200.0]
        # Ids that restores make are edited, deleted and restored later in the same log.
        target = rng.choice(["old0"] * 5 + ids[:8] + ["ghost"] + ids[8:] * 3)
        if op == "restore":
            ids.append(restored_id(target, seq))
        log.append(
            (seq, op, target, rng.choice(list(assets)) if op == "create" else None,
             rng.choice(["bbox", "bbox", "classification", None]) if op == "create" else None,
             rng.choice(["car", "PERSON", "dog", None, None]) if op != "create" else rng.choice(["car", "Car", "person", "dog"]),
             *box, pixel, rng.choice([None, None, None, 3.0, -1.0]), rng.choice([None, None, None, 100.4, 4000.0, 9000.0]),
             rng.choice([None, "n"]), rng.random() < 0.2, rng.choice(["u1", "u2"]), T0 + timedelta(seconds=seq), rng.random() < 0.15)
        )
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    data = spark.createDataFrame([("C", "L")], "dataset_id string, label_set_id string")
    out = apply_annotation_edits(
        boxes_df(spark, rows), empty(spark, "media_annotation_versions"), spark.createDataFrame(log, LOG),
        spark.createDataFrame(asset_rows, table_type("media_assets")), vocabulary.class_list(data, sets), limit,
    )
    live, versions, rejects = edit_in_turn(start, log, assets)
    assert sorted(map(tuple, out.rejects.collect())) == sorted(rejects)
    got = [(r.annotation_id, r.revision, r.change_type, tuple(r.changed_fields), r.restored_from) for r in out.versions.collect()]
    assert sorted(map(str, got)) == sorted(map(str, versions))
    after = {
        r.annotation_id: (r.asset_id, r.kind, r.label, r.note, r.x, r.y, r.box_width, r.box_height, r.frame_index, r.timestamp_ms, r.revision)
        for r in out.annotations.collect()
    }
    assert after == {
        k: (v["asset"], v["kind"], v["label"], v["note"], v["x"], v["y"], v["w"], v["h"], v["frame"], v["ms"], v["rev"])
        for k, v in live.items()
    }
    assert len(versions) > 20 and len(rejects) > 40
    assert seed == 3 or any(v[2] == "update" and v[0] in {r[0] for r in versions if r[2] == "restore"} for v in versions)


def test_a_frame_is_cleared(spark):
    assets = [("v", "C", "video", "v", "x", None, 1, "v", 640, 480, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0)]
    rows = [("a1", "v", "C", "bbox", "car", 0.1, 0.2, 0.3, 0.4, 7, 300, 640, 480, None, 1, "u", "u", T0, T0)]
    none = (None,) * 4
    log = [
        (0, "update", "a1", None, None, None, *none, False, None, None, None, False, "u", T0, True),
        (1, "update", "a1", None, None, None, *none, False, None, None, None, False, "u", T0, None),
        (2, "update", "a1", None, None, None, *none, False, 9.0, None, None, False, "u", T0, True),
    ]
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    data = spark.createDataFrame([("C", "L")], "dataset_id string, label_set_id string")
    classes = vocabulary.class_list(data, sets)
    frame = spark.createDataFrame(log, LOG)
    out = apply_annotation_edits(
        boxes_df(spark, rows), empty(spark, "media_annotation_versions"), frame, spark.createDataFrame(assets, table_type("media_assets")), classes
    )
    got = sorted((r.revision, r.changed_fields, r.snapshot.frame_index, r.snapshot.timestamp_ms) for r in out.versions.collect())
    assert got == [(2, ["frameIndex"], None, 300), (4, ["frameIndex"], 9, 300)] and out.rejects.isEmpty()


def test_edits_sort_the_log_once(spark):
    """Without hot keys all folds share one exchange of the log by annotation."""
    log = spark.createDataFrame([], LOG)
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    classes = vocabulary.class_list(spark.createDataFrame([("C", "L")], "dataset_id string, label_set_id string"), sets)
    seen = []
    keep = media_edits.staged
    media_edits.staged = lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name)
    try:
        apply_annotation_edits(
            boxes_df(spark, []), empty(spark, "media_annotation_versions"), log, spark.createDataFrame([], table_type("media_assets")), classes
        )
    finally:
        media_edits.staged = keep
    assert len(seen) == 2
    plan = seen[1].split("Window")
    # Between the first window node and the last no exchange stands but those that broadcast labels.
    inner = "Window".join(plan[1:-1])
    assert "hashpartitioning" not in inner and len(plan) > 5


def test_edits_need_a_label_set_and_keep_whole_notes(spark):
    assets = [
        (k, k.upper(), "image", k, "x", None, 1, k, 800, 600, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0)
        for k in ("c", "d")
    ]
    rows = [(f"{k}1", k, k.upper(), "bbox", "car", 0.1, 0.2, 0.3, 0.4, None, None, 800, 600, None, 1, "u", "u", T0, T0) for k in ("c", "d")]
    none = (None,) * 4
    log = [
        (0, "create", "c2", "c", "bbox", "car", 0.1, 0.1, 0.2, 0.2, False, None, None, None, False, "u1", T0),
        (1, "create", "d2", "d", "bbox", "car", 0.1, 0.1, 0.2, 0.2, False, None, None, None, False, "u1", T0),
        (2, "update", "c1", None, None, None, *none, False, None, None, "n" * 3000, True, "u1", T0),
        (3, "update", "d1", None, None, None, *none, False, None, None, "n", True, "u1", T0),
        (4, "delete", "d1", None, None, None, *none, False, None, None, None, False, "u1", T0),
    ]
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    data = spark.createDataFrame([("C", "L"), ("D", None)], "dataset_id string, label_set_id string")
    out = apply_annotation_edits(
        boxes_df(spark, rows), empty(spark, "media_annotation_versions"), spark.createDataFrame([(*r, False) for r in log], LOG),
        spark.createDataFrame(assets, table_type("media_assets")), vocabulary.class_list(data, sets),
    )
    refusal = "This dataset has no label set. Assign one before annotating."
    assert sorted(map(tuple, out.rejects.collect())) == [("d1", 3, refusal), ("d2", 1, refusal)]
    assert {r.annotation_id: r.note and len(r.note) for r in out.annotations.collect()} == {"c1": 3000, "c2": None}


def test_a_large_log_moves_the_annotations_once(spark, monkeypatch):
    """Its ids are not gathered to choose the annotations, nor counted one by one, and the results are the same."""
    from labelmill.operators import hotkeys

    assets = [("c", "C", "image", "c", "x", None, 1, "c", 800, 600, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0)]
    third = 1 / 3
    rows = [(f"c{i}", "c", "C", "bbox", "car", third, 0.2, 0.3, 0.4, None, None, 800, 600, None, 1, "u", "u", T0, T0) for i in range(6)]
    none = (None,) * 4
    log = [
        (0, "update", "c0", None, None, "person", *none, False, None, None, None, False, "u1", T0, False),
        (1, "update", "c0", None, None, "person", *none, False, None, None, None, False, "u1", T0, False),
        (2, "delete", "c1", None, None, None, *none, False, None, None, None, False, "u1", T0, False),
        (3, "restore", "c1", None, None, None, *none, False, None, None, None, False, "u1", T0, False),
        # Named by a refused restore, by a row without an operation, by an unknown one; and an id that is not there.
        (4, "restore", "c2", None, None, None, *none, False, None, None, None, False, "u1", T0, False),
        (5, None, "c3", None, None, None, *none, False, None, None, None, False, "u1", T0, False),
        (6, "base", "c4", None, None, None, *none, False, None, None, None, False, "u1", T0, False),
        (7, "update", None, None, None, "person", *none, False, None, None, None, False, "u1", T0, False),
        (8, "create", "c9", "c", None, "car", 0.1, 0.1, 0.2, 0.2, False, None, None, "n", False, "u1", T0, False),
    ]
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    classes = vocabulary.class_list(spark.createDataFrame([("C", "L")], "dataset_id string, label_set_id string"), sets)
    live = boxes_df(spark, rows)
    live = live.unionByName(live.where("annotation_id = 'c5'").withColumn("annotation_id", F.lit(None).cast("string")))

    def run():
        out = apply_annotation_edits(live, empty(spark, "media_annotation_versions"), spark.createDataFrame(log, LOG), spark.createDataFrame(assets, table_type("media_assets")), classes)
        return [sorted(map(str, df.collect())) for df in (out.annotations, out.versions, out.rejects)]

    small, plans, counted = run(), [], []
    monkeypatch.setattr(media_edits, "is_small", lambda df: False)
    monkeypatch.setattr(media_edits, "TASK_ROWS", 1)
    keep, mark = media_edits.staged, hotkeys.staged
    monkeypatch.setattr(media_edits, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    monkeypatch.setattr(hotkeys, "staged", lambda df, name: counted.append(name) or mark(df, name))
    assert run() == small and len(small[0]) == 8 and len(small[1]) == 4 and len(small[2]) == 3
    assert "LeftSemi" not in plans[1] and counted == ["large-buckets"]


def test_a_very_large_log_is_folded_in_rounds(spark, monkeypatch):
    """With more tasks than a shuffle writes without sorting, ids take turns, and the results are the same."""
    assets = [("c", "C", "image", "c", "x", None, 1, "c", 800, 600, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0)]
    # Some were edited before.
    rows = [(f"c{i}", "c", "C", "bbox", "car", 0.1, 0.2, 0.3, 0.4, None, None, 800, 600, None, 1 + i % 2, "u", "uv"[i % 2], T0, T0) for i in range(6)]
    none = (None,) * 4
    ops = ["update", "delete", "restore", "create", "update", "restore"]
    log = [
        (s, op, f"c{s % 8}" if s % 9 else None, "c", None, "person", *((0.1, 0.1, 0.2, 0.2) if op == "create" else none), False, None, None, "n", op == "update", "w", T0, False)
        for s, op in enumerate(ops * 8)
    ]
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    classes = vocabulary.class_list(spark.createDataFrame([("C", "L")], "dataset_id string, label_set_id string"), sets)

    def run():
        out = apply_annotation_edits(boxes_df(spark, rows), empty(spark, "media_annotation_versions"), spark.createDataFrame(log, LOG), spark.createDataFrame(assets, table_type("media_assets")), classes)
        return [sorted(map(str, df.collect())) for df in (out.annotations, out.versions, out.rejects)]

    small, written = run(), []
    monkeypatch.setattr(media_edits, "is_small", lambda df: False)
    monkeypatch.setattr(media_edits, "TASK_ROWS", 12)
    monkeypatch.setattr(media_edits, "BYPASS_PARTITIONS", 2)
    keep = media_edits.staged
    monkeypatch.setattr(media_edits, "staged", lambda df, name: written.append(name) or keep(df, name))
    assert run() == small and all(small) and written == ["classes", *["edited"] * 3]


def test_boxes_are_joined_as_plain_lines(spark, tmp_path):
    """What is made of a line is longer than the line, so it is made behind the join."""
    from checks.tables import Tables

    line = (10, 2, 3, 4, 5.0, 60.5, 0.01, 0.02, "A", "F", T0)
    spark.createDataFrame(
        [line, (11, *line[1:])],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, "1-URGENT")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    boxes = Tables(spark, str(tmp_path)).annotations
    below = boxes._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "concat_ws" not in below and "l_extendedprice" in below
    assert [(r.annotation_id, r.asset_id, r.dataset_id, r.x, r.box_height, r.frame_index) for r in boxes.collect()] == [
        ("10-2-3-4-6050", "10", "1-URGENT", 0.02, 0.571429, 4)
    ]


def test_restores_are_decided_in_the_pass_of_the_log(spark):
    """Without a history before the log nothing is moved for them behind the folds; with one, it is looked up."""
    assets = [("c", "C", "image", "c", "x", None, 1, "c", 800, 600, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0)]
    rows = [(f"c{i}", "c", "C", "bbox", "car", 0.1, 0.2, 0.3, 0.4, None, None, 800, 600, None, 1, "u", "u", T0, T0) for i in range(3)]
    edit = lambda s, op, i, label=None: (s, op, i, None, None, label, *(None,) * 4, False, None, None, None, False, f"u{s}", T0, False)
    log = [
        edit(0, "restore", "c0"), edit(1, "update", "c0", "person"), edit(2, "restore", "c0"), edit(3, "delete", "c0"),
        edit(4, "restore", "c0"), edit(5, "restore", "c0"), edit(6, "restore", "old"), edit(7, "restore", "kept"),
        edit(8, "restore", None), edit(9, "restore", "ghost"), edit(10, "update", "old", "car"),
    ]
    sets = spark.createDataFrame([("L", SCENE_LABELS)], "label_set_id string, labels array<struct<value:string,label:string,color:string>>")
    classes = vocabulary.class_list(spark.createDataFrame([("C", "L")], "dataset_id string, label_set_id string"), sets)
    snap = ("c", "C", "bbox", "car", 0.1, 0.2, 0.3, 0.4, None, None, 800, 600, "n", "u")
    past = [
        ("old", "c", "C", 1, snap, [], "create", None, "u", T0), ("old", "c", "C", 2, snap, [], "delete", None, "u", T0),
        ("kept", "c", "C", 1, snap, [], "create", None, "u", T0),
    ]
    run = lambda old: apply_annotation_edits(boxes_df(spark, rows), old, spark.createDataFrame(log, LOG), spark.createDataFrame(assets, table_type("media_assets")), classes)
    none, alive = "No history for this annotation", "This annotation is not deleted; edit it instead"
    gone = [(None, 8, none), ("c0", 0, none), ("c0", 2, alive), ("ghost", 9, none), ("old", 10, "Annotation not found")]
    out = run(empty(spark, "media_annotation_versions"))
    for made in (out.rejects, out.versions):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.rejects.collect()), key=str) == sorted([*gone, ("old", 6, none), ("kept", 7, none)], key=str)
    back = lambda df: sorted((r.annotation_id, r.restored_from, r.snapshot.label, r.snapshot.created_by, r.changed_by) for r in df.where("change_type = 'restore'").collect())
    here = [(restored_id("c0", s), 3, "person", "u", f"u{s}") for s in (4, 5)]
    assert back(out.versions) == sorted(here)
    out = run(spark.createDataFrame(past, table_type("media_annotation_versions")))
    assert sorted(map(tuple, out.rejects.collect()), key=str) == sorted([*gone, ("kept", 7, alive)], key=str)
    assert back(out.versions) == sorted([*here, (restored_id("old", 6), 2, "car", "u", "u6")])
