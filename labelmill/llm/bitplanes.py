"""Token ids in binary files: blocks of ids transposed into byte or bit planes.

Documents are dealt to files by ascending id. A file is a run of segments; a segment holds the
ids of some whole documents:

    magic, bytes per id, plane kind, documents, ids, chunks, lengths of the parts   header
    document ids, null flags, token counts                                          zstandard
    planes of chunk 0, chunk 1, ...                                                 zstandard each
    length of every plane                                                           chunk index

A chunk is a block of ``chunk_ids`` ids (the last may be shorter) seen as a matrix of ids by
bytes (or bits), transposed, each row of the transpose compressed alone: high bytes of frequent
ids repeat and shrink, and a reader inflates single chunks through the index. Segments reach the
shared folder through Spark's text writer, which commits whole tasks; its separator ends each
segment and is checked on reading. A file holds at most ``file_segments`` segments.

Defined results: a null text is empty and has only the end id; null ids come first; rows that
repeat an id are ordered by text; an empty table gives a folder without segments and an empty
result; other columns are not read.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelmill.llm.memory import tidy
from labelmill.llm.tokens import PieceEncoder, piece_encoder
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import shared_dir, staged

MAGIC = b"BPLN"
END = b"NLPB"
HEADER = struct.Struct("<4sBBIQIIQI")
BATCH_TEXTS = 256
FILES_A_TASK = 1_000_000


@dataclass(frozen=True)
class Format:
    """``tokenizer`` is a tokenizer file that every executor can read; ``planes`` is ``byte`` or ``bit``."""

    tokenizer: str
    end_id: int = 0
    planes: str = "byte"
    chunk_ids: int = 65_536
    segment_ids: int = 500_000
    level: int = 3
    file_segments: int = 32


def default_format() -> Format:
    import public_tokenizers

    return Format(public_tokenizers.path("byte_bpe_50k.json"))


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """The planes of one block; ``width`` bytes per id."""
    matrix = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "bit":
        return [p.tobytes() for p in np.packbits(np.unpackbits(matrix, axis=1, bitorder="little").T, axis=1)]
    return [p.tobytes() for p in np.ascontiguousarray(matrix.T)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = rows.T
    return out.view("<u4").ravel()


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int, form: Format) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=form.level).compress
    given = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [pack(given.tobytes()), pack(nulls.tobytes()), pack(np.array(counts, "<u4").tobytes())]
    planes = [
        pack(p)
        for at in range(0, len(ids), form.chunk_ids)
        for p in to_planes(ids[at : at + form.chunk_ids], width, form.planes)
    ]
    body, index = b"".join(planes), np.array([len(p) for p in planes], "<u4").tobytes()
    docs = struct.pack("<III", *map(len, parts)) + b"".join(parts)
    head = HEADER.pack(
        MAGIC, width, form.planes == "bit", len(counts), len(ids), form.chunk_ids, len(docs), len(body), len(index)
    )
    return head + docs + body + index


def segments_of(data: bytes | memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, token counts and ids of each segment of a file."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at, view = 0, memoryview(data)
    while at < len(data):
        magic, width, bits, _, n, chunk, docs, body, index = HEADER.unpack_from(data, at)
        end = at + HEADER.size + docs + body + index
        if magic != MAGIC or data[end : end + len(END)] != END:
            raise ValueError("a damaged segment")
        at += HEADER.size
        sizes = struct.unpack_from("<III", data, at)
        parts, where = [], at + 12
        for size in sizes:
            parts.append(unpack(view[where : where + size]))
            where += size
        given, nulls, counts = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4")
        at += docs
        lengths = np.frombuffer(view[at + body : at + body + index], "<u4").astype(np.int64)
        starts = at + np.concatenate([[0], np.cumsum(lengths)])
        kind, per = ("bit", 8 * width) if bits else ("byte", width)
        blocks = [
            from_planes(
                [unpack(view[starts[p] : starts[p + 1]]) for p in range(c * per, (c + 1) * per)],
                min(chunk, n - c * chunk), width, kind,
            )
            for c in range(-(-n // chunk))
        ]
        yield (
            [None if z else int(d) for d, z in zip(given, nulls)],
            counts,
            np.concatenate(blocks) if blocks else np.zeros(0, "<u4"),
        )
        at = end + len(END)


class Encoder(PieceEncoder):
    """Ids of whole texts, as little-endian 32-bit bytes, equal to the tokenizer's own."""

    def __call__(self, column: pa.Array) -> list[bytes]:
        ids, counts = self.encode(column)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[e - 4 * n : e] for e, n in zip(ends, counts.tolist())]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows with ``end_id`` behind each row's, and the new counts."""
    out = np.full(len(ids) + len(counts), end_id, kind)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def _segments(form: Format):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(form.tokenizer)
        width = 1 + (max(encoder.vocabulary - 1, form.end_id) >= 1 << 8) + (encoder.vocabulary > 1 << 16) + (encoder.vocabulary > 1 << 24)
        docs, counts, held, n = [], [], [], 0

        def flush():
            nonlocal docs, counts, held, n
            data = pack_segment(docs, np.concatenate(counts), np.concatenate(held), width, form)
            docs, counts, held, n = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                names = part.column("doc_id").to_pylist()
                ids, sizes = with_end(*encoder.encode(part.column("text")), form.end_id)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                low = 0
                while low < len(names):
                    # Up to the document that fills the segment.
                    high = int(np.searchsorted(upto, upto[low] + form.segment_ids - n))
                    high = min(max(high, low + 1), len(names))
                    docs += names[low:high]
                    counts.append(sizes[low:high])
                    held.append(ids[upto[low] : upto[high]])
                    n += int(upto[high] - upto[low])
                    low = high
                    if n >= form.segment_ids:
                        yield flush()
        if docs:
            yield flush()

    return write


def write_ids(docs: DataFrame, path: str, form: Format) -> None:
    """Encode ``text`` and write files of ascending ``doc_id``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # The text's hash splits an id that very many rows repeat.
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("_tie")
    (
        laid.mapInArrow(_segments(form), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", END.decode("latin-1"))
        .option("maxRecordsPerFile", form.file_segments)
        .text(path)
    )


@tidy
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
            place = start = 0
            for docs, counts, ids in segments_of(memoryview(content.as_buffer())):
                ends = np.cumsum(counts, dtype=np.int64)
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int64()),
                        pa.array(range(place, place + len(docs)), pa.int64()), pa.array(start + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())], pa.binary()),
                    ],
                    ["doc_id", "part", "place", "start", "n_tokens", "ids"],
                )
                place += len(docs)
                start += int(ends[-1]) if len(ends) else 0


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part (file, ascending with its documents), place and start (documents and ids before it in its file), n_tokens, ids (little-endian
    32-bit bytes, end id included) of every document in a folder."""
    files = spark.read.format("binaryFile").load(path)
    # A task's number, and that of its file where it wrote several.
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("long") * FILES_A_TASK + F.regexp_extract("path", r"-c(\d+)\.", 1).cast("long")
    return files.select(part.alias("part"), "content").mapInArrow(
        _documents, "doc_id long, part long, place long, start long, n_tokens long, ids binary"
    )


def index_of(documents: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32: the document index of a folder."""
    rows = staged(documents.select("doc_id", "part", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-index")
    # One row per file.
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    joined = rows.join(broadcast_if_small(files), F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def ids_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
