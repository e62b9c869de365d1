"""WARC archives: writing, reading, and revisit resolution by payload digest.

Of the records with one payload the latest is kept as a response and the others become revisit
records that refer to it. Only headers (id, digest, length) are shuffled by digest, and a digest's
latest id is folded before the shuffle; payloads are dealt by record id, which is even.

Archives are part files of one folder in any file system Spark can write. A task compresses each
record as a gzip member of its own, as the format wants, and Spark's text writer lays the members
end to end; as that writer needs a separator, the separator is an empty gzip member. Task commits
are Spark's own, so a lost executor leaves no half file.

Defined results: a null payload is an empty one; a null url has no target header; a null id is
written as ``null`` and read back as null, and refers to the group's largest id; when all ids of a group
are null its records are all responses; rows that repeat the largest id of a group are all
responses; an empty table gives a folder without records; other columns are dropped.
"""

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.memory import tidy
from labelmill.llm.skew import spread_join
from labelmill.llm.skew import spread_join
from labelmill.staging import shared_dir, staged

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:record:"
READ_PIECE = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 20 hex digits at a time would overflow, so 5 at a time give 4 letters."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_digests(records: DataFrame) -> DataFrame:
    """record_id, url, payload (null: empty) with payload_bytes and payload_digest."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    return records.select("record_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )


def revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record_id, payload_digest, refers_to of the records that another one stands for.

    ``headers`` has record_id, payload_bytes and payload_digest. A digest shared by a third of all
    rows is one row after the partial maximum, and is dealt to several tasks in the join back.
    """
    large = staged(headers.where(F.col("payload_bytes") >= min_bytes).select("record_id", "payload_digest"), "warc-headers")
    latest = (
        large.groupBy(F.col("payload_digest").alias("_latest"))
        .agg(F.max("record_id").alias("refers_to"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("refers_to").isNotNull())
        .drop("_n")
    )
    return (
        spread_join(large, latest, "payload_digest", "_latest", F.col("record_id"))
        .drop("_latest")
        .where(~F.col("record_id").eqNullSafe(F.col("refers_to")))
        .distinct()
    )


def deduplicate(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """with_digests plus record_type and refers_to; a revisit's payload is null."""
    rows = with_digests(records)
    found = revisits(rows.drop("payload", "url"), min_bytes).withColumnsRenamed(
        {"record_id": "_id", "payload_digest": "_digest"}
    )
    same = F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    again = F.col("refers_to").isNotNull()
    return (
        rows.join(found, same, "left")
        .drop("_id", "_digest")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("payload", F.when(~again, F.col("payload")))
    )


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(value) -> str:
    return f"<{URN}{'null' if value is None else value}>"


def _members(date: str):
    """A task's records as gzip members, the first one telling what the file is."""

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _record(
            "warcinfo",
            [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
            b"software: labelmill\r\nformat: WARC File Format 1.1\r\n",
        )
        first = [gzip.compress(info, mtime=0)]
        for batch in batches:
            out, first = first, []
            for r in batch.to_pylist():
                fields = [("WARC-Record-ID", _name(r["record_id"])), ("WARC-Date", date)]
                if r["url"] is not None:
                    fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"])))
                fields.append(("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"))
                if r["record_type"] == "revisit":
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(r["refers_to"]))]
                else:
                    fields.append(("Content-Type", "text/html; charset=utf-8"))
                out.append(gzip.compress(_record(r["record_type"], fields, r["payload"] or b""), 6, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return write


def write_archives(records: DataFrame, path: str, date: str, file_records: int = 50_000) -> None:
    """Write deduplicated records (as of ``deduplicate``) with fresh headers; ``date`` goes into each."""
    rows = records.select("record_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    members = rows.mapInArrow(_members(date), "value binary")
    (
        members.select(F.col("value").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", file_records)
        .text(path)
    )


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a run of gzip members, in pieces."""
    rest = memoryview(data)
    while len(rest):
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof and len(rest):
            piece, rest = rest[:READ_PIECE], rest[READ_PIECE:]
            yield inflate.decompress(piece)
            if inflate.eof and inflate.unused_data:
                used = len(piece) - len(inflate.unused_data)
                rest = memoryview(data)[len(data) - len(rest) - len(piece) + used :]


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    pieces, have = unpacked(data), b""

    def upto(n: int) -> bool:
        nonlocal have
        more = []
        got = len(have)
        for piece in pieces if got < n else ():
            more.append(piece)
            got += len(piece)
            if got >= n:
                break
        have = b"".join([have, *more]) if more else have
        return len(have) >= n

    while True:
        end = have.find(b"\r\n\r\n")
        while end < 0 and upto(len(have) + 1):
            end = have.find(b"\r\n\r\n")
        if end < 0:
            if have.strip():
                raise ValueError("an archive ends within a record's headers")
            return
        lines = have[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should start: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if not upto(end + 4 + size + 4):
            raise ValueError("an archive ends within a record's block")
        yield fields, have[end + 4 : end + 4 + size]
        have = have[end + 4 + size + 4 :]


READ_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
        ("refers_to", pa.string()), ("payload", pa.binary()),
    ]
)
BATCH_BYTES = 8 << 20


def _id(name: str | None) -> str | None:
    value = None if name is None else name.strip("<>").removeprefix(URN)
    return None if value == "null" else value


@tidy
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for fields, block in records_of(content.as_py()):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                rows.append(
                    {
                        "record_id": _id(fields["warc-record-id"]), "record_type": kind, "url": fields.get("warc-target-uri"),
                        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                        "refers_to": _id(fields.get("warc-refers-to")), "payload": block if kind == "response" else None,
                    }
                )
                held += len(block)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of a folder's archives; ids are text, a revisit has no payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        _parse, "record_id string, record_type string, url string, payload_digest string, refers_to string, payload binary"
    )


def resolve(records: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Records with ``columns`` (named expressions of payload and payload_digest), a revisit's taken from
    the response it refers to: that of the id and the payload digest in its headers, since ids may be repeated.
    Only these columns meet in the join; name ``payload`` itself to get it whole. Null where there is no such response."""
    link = lambda of: F.concat(F.coalesce(F.concat(F.lit("="), F.col(of)), F.lit("")), F.lit(" "), F.col("payload_digest"))
    again = F.col("record_type") == "revisit"
    rows = staged(
        records.select(
            "record_id", "record_type", "url", "refers_to", F.when(again, link("refers_to")).otherwise(link("record_id")).alias("_link"),
            *[c.alias(n) for n, c in columns.items()],
        ),
        "warc-records",
    )
    originals = rows.where(~again).groupBy(F.col("_link").alias("_original")).agg(F.min(F.struct(*columns)).alias("_of"))
    resolved = spread_join(rows.where(again).drop(*columns), originals, "_link", "_original", F.col("record_id"), "left")
    return rows.where(~again).unionByName(
        resolved.withColumns({n: F.col("_of")[n] for n in columns}).drop("_original", "_of")
    ).drop("_link")


def archive_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
