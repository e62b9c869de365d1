import base64
import gzip
import hashlib
import io

from pyspark.sql import functions as F

from labelmill.llm import warc

PAGES = [
    (1, "http://a/1", b"same"), (2, "http://a/ 2\r\n", b"same"), (3, None, b"other\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", b""),
    (None, "n", b"same"), (None, "n", b"alone"), (6, "u", b"\xff\x00\x1f\x8b" * 700_000), (7, "u", b"twice"), (7, "u", b"twice"), (8, "u", b"same"),
]


def written(spark, rows, **how):
    pages = spark.createDataFrame(rows, "record_id long, url string, payload binary").withColumn("record_type", F.lit("x"))
    path = warc.archive_folder(spark)
    warc.write_archives(warc.deduplicate(pages, **how), path, date="2024-01-01T00:00:00Z")
    return path


def resolved(spark, path):
    return warc.resolve(warc.read_archives(spark, path), {"payload": F.col("payload")}).collect()


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip_and_revisits(spark):
    path = written(spark, PAGES)
    want = []
    for page, _, payload in PAGES:
        group = [p for p, _, b in PAGES if (b or b"") == (payload or b"") and p is not None]
        top = max(group, default=None)
        again = top is not None and page != top
        text = lambda v: None if v is None else str(v)
        want.append((text(page), "revisit" if again else "response", text(top) if again else None, payload or b""))
    got = [(r["record_id"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in resolved(spark, path)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    headers = warc.read_archives(spark, path).select("record_id", "payload_digest").collect()
    assert {(r[0], r[1]) for r in headers} == {(None if p is None else str(p), digest(b or b"")) for p, _, b in PAGES}


def test_files_are_gzip_members_of_whole_records(spark):
    path = written(spark, PAGES)
    for row in spark.read.format("binaryFile").load(path).select("content").collect():
        data = gzip.GzipFile(fileobj=io.BytesIO(bytes(row["content"]))).read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.endswith(b"\r\n\r\n")


def test_repeated_ids_with_different_payloads(spark):
    pages = [(7, "u", b"AAA"), (7, "v", b"BBB"), (5, "u", b"AAA"), (5, "v", b"BBB"), (None, "u", b"AAA"), (None, "v", b"CCC"), (None, "w", b"DDD")]
    got = sorted((r["record_id"] or "", r["url"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in resolved(spark, written(spark, pages)))
    assert got == [
        ("", "u", "revisit", "7", b"AAA"), ("", "v", "response", None, b"CCC"), ("", "w", "response", None, b"DDD"),
        ("5", "u", "revisit", "7", b"AAA"), ("5", "v", "revisit", "7", b"BBB"), ("7", "u", "response", None, b"AAA"), ("7", "v", "response", None, b"BBB"),
    ]


def test_small_payloads_can_stay_whole(spark):
    kinds = {r["record_id"]: r["record_type"] for r in resolved(spark, written(spark, PAGES, min_bytes=5))}
    assert kinds["1"] == kinds["4"] == "response"


def test_empty(spark):
    assert resolved(spark, written(spark, [])) == []
