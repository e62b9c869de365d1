"""Sources and sinks that touch files."""

import glob
import hashlib
import io
import json
import os
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from labelmill.operators import media, splits
from labelmill.plans import exports
from labelmill.schemas import TABLES, table_type
from labelmill.sinks import text_files, vision_files
from labelmill.sources import listing, media_files, tables

T0 = datetime(2026, 2, 1)


def png(w, h):
    head = struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00"
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(w, h, fill=b"", frame=0xC2):
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9
    out += b"\xff\xe1" + struct.pack(">H", len(fill) + 2) + fill
    out += b"\xff\xff\xc4" + struct.pack(">H", 6) + b"\0" * 4
    return out + bytes([0xFF, frame]) + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 20


def tiff(w, h, order="<"):
    tags = [(256, 3, w), (257, 4, h), (258, 3, 8)]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(tags))
    for tag, kind, value in tags:
        body = struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value)
        out += struct.pack(order + "HHI", tag, kind, 1) + body
    return out + b"\0" * 4


def mp4(ms, version=0, lead=b""):
    if version:
        body = struct.pack(">B3xQQIQ", 1, 0, 0, 1000, ms)
    else:
        body = struct.pack(">B3xIIII", 0, 0, 0, 1000, ms)
    mvhd = struct.pack(">I4s", len(body) + 8, b"mvhd") + body
    moov = struct.pack(">I4s", len(mvhd) + 8, b"moov") + mvhd
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(lead)) + lead
    return struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + mdat + moov


def webp(chunk, payload):
    return b"RIFF" + struct.pack("<I", 100) + b"WEBP" + chunk + struct.pack("<I", 50) + payload


FILES = {
    "a.png": (png(640, 480), 640, 480, None), "big.JPG": (jpeg(1234, 567, b"\xff" * 60000), 1234, 567, None),
    "le.tif": (tiff(300, 200), 300, 200, None), "be.tiff": (tiff(31, 77, ">"), 31, 77, None),
    "g.gif": (b"GIF89a" + struct.pack("<HH", 10, 20) + b"\0" * 9, 10, 20, None),
    "b.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 33, -44) + b"\0" * 9, 33, 44, None),
    "v8.webp": (webp(b"VP8 ", b"\0" * 3 + b"\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 55, 66) + b"\0" * 9), 55, 66, None),
    "vl.webp": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (99 - 1) | ((88 - 1) << 14)) + b"\0" * 9), 99, 88, None),
    "vx.webp": (webp(b"VP8X", b"\0" * 4 + struct.pack("<I", 70000 - 1)[:3] + struct.pack("<I", 300 - 1)[:3] + b"\0" * 9), 70000, 300, None),
    "m0.mp4": (mp4(65000), None, None, 65000), "m1.mov": (mp4(7_000_000_000, 1, b"x" * 500), None, None, 7_000_000_000),
    "cut.mp4": (mp4(65000)[:-6], None, None, None), "junk.png": (b"not an image", None, None, None),
    "w.webm": (b"\x1a\x45\xdf\xa3abc", None, None, None), "cut.jpg": (jpeg(10, 10)[:12], None, None, None),
}


def test_media_catalog(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, (data, *_) in FILES.items():
        (tmp_path / "deep" / name).write_bytes(data)
    (tmp_path / "copy.png").write_bytes(png(640, 480))
    (tmp_path / "none").write_bytes(b"x")
    (tmp_path / "x.txt").write_bytes(b"x")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "huge.png").write_bytes(png(90000, 90000))
    (tmp_path / "fat.png").write_bytes(b"\0" * 70000)
    limits = media_files.Limits(max_bytes=65000, max_pixels=50_000_000)
    found = media_files.media_catalog(spark, str(tmp_path), "D", "u", T0, limits)
    got = {r.file_name: r for r in found.assets.collect()}
    for name, (data, w, h, ms) in FILES.items():
        assert (got[name].width, got[name].height, got[name].duration_ms, got[name].size_bytes) == (w, h, ms, len(data)), name
    assert got["a.png"].kind == "image" and got["m1.mov"].mime_type == "video/quicktime" and got["big.JPG"].extension == "jpg"
    assert set(found.assets.columns) == set(table_type("media_assets").names)
    why = {r.file_name: r.reason for r in found.rejects.collect()}
    assert set(why) == {"none", "x.txt", "huge.png", "fat.png", "empty.png"}
    assert why["empty.png"] == "Uploaded file is empty"
    assert {r.checksum for r in found.assets.collect()} >= {hashlib.sha256(data).hexdigest() for data, *_ in FILES.values()}
    plan = found.assets._jdf.queryExecution().toString()
    assert "content" not in plan and "binaryFile" not in plan
    assert "no file extension" in why["none"] and why["x.txt"].startswith('Unsupported file type ".txt"')
    assert "90000x90000 (8100000000 pixels)" in why["huge.png"] and "exceeds" in why["fat.png"]
    copies = media.checksum_duplicates(found.assets)
    assert copies.count() == 1
    report = media_files.upload_report(found.assets.join(copies, "asset_id", "left_anti"), copies, found.rejects)
    assert report.agg(F.sum("files")).first()[0] == len(FILES) + 6


def test_a_video_over_two_gigabytes(spark, tmp_path):
    lead = 2_300_000_000
    whole = mp4(65000)
    moov = whole[whole.index(b"moov") - 4 :]
    with open(tmp_path / "long film.mp4", "wb") as f:
        f.write(struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4sQ", 1, b"mdat", 16 + lead))
        # A hole: no blocks of the disk are used.
        f.seek(lead, os.SEEK_CUR)
        f.write(moov)
    row = media_files.media_catalog(spark, str(tmp_path), "D", "u", T0).assets.first()
    assert (row.duration_ms, row.size_bytes, row.file_name) == (65000, 32 + lead + len(moov), "long film.mp4")
    with open(tmp_path / "long film.mp4", "rb") as f:
        assert row.checksum == hashlib.file_digest(f, "sha256").hexdigest()


def test_listing_of_folders(spark, tmp_path):
    for name in ("a/b/c/x.txt", "a/y z.txt", "_hidden/x", "a/.hidden", "top"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "none").mkdir()
    want = {f"file:{tmp_path}/{n}": len(n) for n in ("a/b/c/x.txt", "a/y z.txt", "top")}
    for path in (str(tmp_path), f"file:{tmp_path}"):
        assert {r.path: r.length for r in listing.list_files(spark, path).collect()} == want
    assert listing.list_files(spark, str(tmp_path / "none")).collect() == []


def test_ranges_equal_slices():
    data = bytes(range(256)) * 40
    ranged = listing.Ranged(io.BytesIO(data), len(data), block=100)
    assert all(ranged.part(at, n) == data[at : at + n] for at in (0, 99, 100, 5000, 10_239) for n in (0, 1, 150, 3000))
    assert ranged.find(b"\xff", 0) == 255 and ranged.find(b"\x05", 10_000) == data.find(b"\x05", 10_000)
    assert ranged.find(b"\x00", len(data) - 3) == -1


def test_tables_keep_declared_shape(spark, tmp_path):
    df = spark.createDataFrame([("a", "D", 5, "junk")], "comment_id string, dataset_id string, version int, junk string")
    path = str(tmp_path / "t")
    tables.write_table(df, "comments", path, ["dataset_id"])
    back = tables.load_table(spark, "comments", path)
    assert back.columns == table_type("comments").names and back.first().version == 5
    with pytest.raises(ValueError):
        tables.load_table(spark, "nope", path)
    assert all(table_type(n) for n in TABLES)


def joined(folder):
    return "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(folder + "/part-*")))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (f"{i:03d}", "D", f"r{i}", f'=t{i}, "q"\nend' if i % 2 else f"t{i}", "positive", "english", "annotated" if i < 25 else "pending",
         None, None, None, None, T0 if i < 25 else None, None, 1, "u", "u", datetime(2026, 2, 1, 0, 0, 59 - i), T0)
        for i in range(30)
    ]
    sets = spark.createDataFrame([("D", "Bank", None)], "dataset_id string, name string, taxonomy_name string")
    return spark.createDataFrame(rows, table_type("comments")), sets


def test_split_is_exact_and_ordered(labelled):
    got = {r.comment_id: r.split for r in splits.split_dataset(labelled[0]).collect()}
    assert [got[f"{i:03d}"] for i in range(25)] == ["train"] * 20 + ["val"] * 2 + ["test"] * 3
    small = {r.split for r in splits.split_dataset(labelled[0].where("comment_id < '001'")).collect()}
    assert small == {"test"}
    with pytest.raises(ValueError):
        splits.split_dataset(labelled[0], (0.8, 0.1, 0.2))


def test_text_exports(labelled, tmp_path):
    comments, sets = labelled
    rows = exports.ml_rows(splits.split_dataset(comments), sets)
    text_files.write_ml_jsonl(rows, str(tmp_path / "j"))
    lines = joined(str(tmp_path / "j/dataset_id=D")).splitlines()
    assert len(lines) == 25 and list(json.loads(lines[0])) == list(text_files.ML_COLUMNS)
    assert [json.loads(x)["id"] for x in lines] == [f"r{i}" for i in range(25)] and json.loads(lines[0])["taxonomy"] == "Default"
    text_files.write_ml_csv(rows, str(tmp_path / "c"))
    body = joined(str(tmp_path / "c/dataset_id=D"))
    assert body.startswith("\ufeffid,text,sentiment,type,split,dataset,taxonomy\r\nr0,t0,positive,english,train,Bank,Default\r\n")
    assert 'r1,"\'=t1, ""q""\nend",positive' in body
    text_files.write_comments_csv(comments, str(tmp_path / "k"), mark=False)
    body = joined(str(tmp_path / "k/dataset_id=D"))
    assert body.startswith("id,comment_text,sentiment,type,status,version,annotatedAt\r\n") and body.count("\r\n") == 31
    assert body.index("\r\nr29,") < body.index("\r\nr0,") and "r0,t0,positive,english,annotated,1,2026-02-01T00:00:00.000Z" in body


@pytest.fixture(scope="module")
def vision(spark):
    assets = [
        ("a", "C", "image", "a.png", "png", None, 1, "x", 800, 600, None, "p", "annotated", 2, None, None, None, "upload", "u", "u", T0, T0),
        ("b", "C", "video", "b.mp4", "mp4", None, 1, "y", None, None, 65000, "p", "annotated", 1, None, None, None, "upload", "u", "u", T0, T0),
        ("c", "C", "image", "", "png", None, 1, "z", 100, 100, None, "p", "annotated", 2, None, None, None, "upload", "u", "u", T0, T0),
        ("e", "C", "image", "e.png", "png", None, 1, "w", 100, 100, None, "p", "annotated", 1, None, None, None, "upload", "u", "u", T0, T0),
        ("n", "C", "image", "n.png", "png", None, 1, "v", 100, 100, None, "p", "pending", 0, None, None, None, "upload", "u", "u", T0, T0),
    ]
    notes = [
        ("1", "a", "C", "bbox", "car", 0.25, 0.5, 0.25, 0.5, None, None, 800, 600, None, 1, "u", "u", T0, T0),
        ("2", "a", "C", "classification", "person", None, None, None, None, None, None, 800, 600, None, 1, "u", "u", T0, T0),
        ("3", "b", "C", "bbox", "car", 0.0, 0.0, 1.0, 1.0, 30, 1000, None, None, None, 1, "u", "u", T0, T0),
        ("4", "c", "C", "bbox", "gone", 0.0, 0.0, 1.0, 1.0, None, None, 100, 100, None, 1, "u", "u", T0, T0),
        ("5", "c", "C", "bbox", "person", 0.1, 0.1, 0.2, 0.4, None, None, 100, 100, None, 1, "u", "u", T0, T0),
        ("6", "e", "C", "classification", "car", None, None, None, None, None, None, 100, 100, None, 1, "u", "u", T0, T0),
    ]
    classes = spark.createDataFrame([("C", 0, "car", "Car"), ("C", 1, "person", "Person")], "dataset_id string, class_id int, value string, name string")
    return spark.createDataFrame(assets, table_type("media_assets")), spark.createDataFrame(notes, table_type("media_annotations")), classes


def test_coco_document(spark, vision, tmp_path):
    coco = exports.to_coco(*vision)
    sets = spark.createDataFrame([("C", "City")], "dataset_id string, name string")
    vision_files.write_coco(coco, sets, str(tmp_path / "coco"), "now")
    doc = json.loads(joined(str(tmp_path / "coco/dataset_id=C")))
    assert list(doc) == ["info", "licenses", "images", "annotations", "categories", "skipped"]
    assert doc["images"] == [
        {"id": "a", "file_name": "a.png", "width": 800, "height": 600}, {"id": "c", "file_name": "c.png", "width": 100, "height": 100}
    ]
    assert doc["annotations"] == [
        {"id": 1, "image_id": "a", "category_id": 0, "bbox": [200, 300, 200, 300], "area": 60000, "iscrowd": 0},
        {"id": 2, "image_id": "c", "category_id": 1, "bbox": [10, 10, 20, 40], "area": 800, "iscrowd": 0},
    ]
    assert [c["name"] for c in doc["categories"]] == ["car", "person"]
    assert sorted((s["asset_id"], s["reason"]) for s in doc["skipped"]) == [
        ("b", "unknown image dimensions"), ("c", 'unknown label "gone"'), ("e", "no bounding boxes")
    ]


def test_yolo_files(vision, tmp_path):
    yolo = exports.to_yolo(*vision, include_unannotated=True)
    assert yolo.image_counts.first().image_count == 3
    assert sorted(r.asset_id for r in yolo.skipped.collect()) == ["c", "e", "n"]
    vision_files.write_yolo(yolo, str(tmp_path))

    def read(name):
        parts = sorted(glob.glob(f"{tmp_path}/C/{name}*"))
        assert len(parts) == 1
        return "".join(open(p).read() for p in parts)

    assert read("classes.txt") == "car\nperson\n"
    assert read("data.yaml") == "# YOLO dataset descriptor\npath: ../\ntrain: images/train\nval: images/val\ntest: images/test\nnc: 2\nnames:\n  0: Car\n  1: Person\n"
    assert read("labels/a.txt") == "0 0.375 0.75 0.25 0.5\n" and read("labels/b_f000030.txt") == "0 0.5 0.5 1 1\n"
    assert read("labels/c.txt") == "1 0.2 0.3 0.2 0.4\n"
    assert not [p for p in glob.glob(f"{tmp_path}/C/**/.*", recursive=True) if os.path.isfile(p)]


def test_archived_yolo_files_are_the_loose_ones(spark, vision, tmp_path):
    import zipfile

    from labelmill.sources.archives import read_archives

    yolo = exports.to_yolo(*vision, include_unannotated=True)
    vision_files.write_yolo(yolo, str(tmp_path / "loose"))
    vision_files.write_yolo(yolo, str(tmp_path / "packed"), members=2)
    loose = {p.relative_to(tmp_path / "loose").as_posix(): p.read_text() for p in (tmp_path / "loose").rglob("*") if p.is_file() and not p.name.startswith(".")}
    packed, found = list((tmp_path / "packed/C").iterdir()), {}
    for p in packed:
        with zipfile.ZipFile(p) as archive:
            assert p.suffix == ".zip" and 0 < len(archive.namelist()) <= 2 and archive.testzip() is None
            found |= {f"C/{n}": archive.read(n).decode() for n in archive.namelist()}
    assert found == loose and len(loose) == 5
    lines = [(f"{r.folder}/{r.file}", r.line) for r in read_archives(spark, str(tmp_path / "packed")).collect()]
    assert sorted(lines) == sorted((n, line) for n, text in loose.items() for line in text.splitlines())


def test_many_short_files_take_few_archives(spark, tmp_path):
    from labelmill.sources.archives import read_archives

    spark.dataSource.register(vision_files.TextFiles)
    rows = spark.range(30_000).select(
        F.concat(F.lit("set "), F.col("id") % 2).alias("folder"), F.format_string("labels/é%05d.txt", F.floor(F.col("id") / 4)).alias("file"), F.col("id").cast("string").alias("line")
    )
    ordered = rows.repartition(2, "folder", "file").sortWithinPartitions("folder", "file", F.col("id").cast("long"))
    ordered.write.format("text_files").option("members", 2500).mode("append").save(str(tmp_path))
    archives = list(tmp_path.rglob("*.zip"))
    assert sorted(os.listdir(tmp_path)) == ["set 0", "set 1"] and 6 <= len(archives) <= 12
    assert sum(p.stat().st_size for p in archives) < 15_000 * 4096 / 10
    back = read_archives(spark, str(tmp_path))
    assert back.count() == 30_000 and back.exceptAll(rows).isEmpty()


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(vision_files.TextFiles)
    rows = spark.range(1000).select(
        F.lit("C").alias("folder"), F.format_string("labels/%03d.txt", F.col("id") % 50).alias("file"),
        F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"),
    )
    rows = rows.repartition("file").sortWithinPartitions("file")
    with pytest.raises(Exception, match="broken"):
        rows.write.format("text_files").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_files_of_attempts_that_do_not_count_are_dropped(tmp_path):
    writer = vision_files._TextFilesWriter(str(tmp_path))
    first, second = (writer.write(iter([("C", "a.txt", "1"), ("C", "a.txt", "2"), ("D", "x/b.txt", str(n))])) for n in range(2))
    with pytest.raises(ValueError):
        writer.write(line for line in [("C", "c.txt", "1"), ("C",)])
    writer.commit([second, None])
    found = {p.relative_to(tmp_path).as_posix(): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"C/a.txt": "1\n2\n", "D/x/b.txt": "1\n"} and sorted(os.listdir(tmp_path)) == ["C", "D"]


def test_files_with_different_headers(spark, tmp_path):
    from labelmill.sources.comment_csv import read_comment_csv

    (tmp_path / "a.csv").write_text("id,Comment Text,type\n1,one,x\n2,two,y\n")
    (tmp_path / "b.csv").write_text("Sentiment,TEXT,Id\npos,three,3\n")
    (tmp_path / "c.csv").write_text("id,Comment Text,type\n4,four,z\n")
    rows = read_comment_csv(spark, str(tmp_path)).collect()
    got = sorted((r.id, r.comment_text, r.sentiment, r.type, r.row_no) for r in rows)
    assert got == [("1", "one", None, "x", 0), ("2", "two", None, "y", 1), ("3", "three", "pos", None, 0), ("4", "four", None, "z", 0)]


def test_box_csv(vision, tmp_path):
    text_files.write_boxes_csv(exports.to_boxes_table(*vision), str(tmp_path / "b"))
    assert joined(str(tmp_path / "b/dataset_id=C")).splitlines() == [
        ",".join(text_files.BOX_COLUMNS), "a,a.png,800,600,car,0,200,300,200,300,,", "c,c.png,100,100,person,1,10,10,20,40,,"
    ]
