"""Packing documents into sequences of fixed length, shortest pack first over the histogram of lengths.

A document's ids fill whole sequences as far as they go; what is left (its rest) is shorter than a
sequence. Only the number of documents with each rest, at most ``length - 1`` numbers, reaches the driver:

1. Rests are placed longest first, each into the shortest open pack if it fits there, else into a new
   pack. Packs alike are one pattern with a count, and a step places as many documents at once as it can.
2. While more than a small share of all is padding, the shortest patterns are opened and their documents moved
   into the next shortest, cut where they do not fit: few cuts remove most of the padding.

A pattern's n-th pack takes the documents of n-th rank, counted from a rank that the pattern keeps for
each of its places. A document's rank among those of its rest is its rank in its task, plus the documents
of earlier tasks, so documents are neither sorted nor shuffled to join the patterns.

A sequence is padded to the full length unless it is a power of two long, so those count as full.

Defined results: a null text is empty and has the end id only; null and repeated ids are documents of their own; an
empty table has no sequences; other columns are not read. One text's ids are held whole by its task.
"""

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.bitplanes import with_end
from labelmill.llm.memory import tidy
from labelmill.llm.tokens import piece_encoder
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

BATCH_TEXTS = 256
# Ranks are below this, lengths times this below 2**63.
RANKS = 1 << 44


@dataclass(frozen=True)
class Packing:
    """``tokenizer`` is a tokenizer file that every executor can read; ``slack`` the share of padding that is worth no cut."""

    tokenizer: str
    end_id: int = 1
    length: int = 2048
    slack: float = 0.002


def default_packing() -> Packing:
    import public_tokenizers

    return Packing(public_tokenizers.path("word_bpe_49k.json"))


def padding(used: int, length: int) -> int:
    """Tokens that pad a sequence of ``used`` ids; none at a power of two."""
    return 0 if used & (used - 1) == 0 else length - used


@dataclass(frozen=True)
class Place:
    """``length`` ids from ``start`` of the rests of ``rest`` ids, for documents of rank ``first``, ``first`` + 1 …"""

    rest: int
    first: int
    start: int
    length: int

    def later(self, n: int) -> "Place":
        return Place(self.rest, self.first + n, self.start, self.length)


@dataclass
class Pattern:
    """``count`` packs alike. ``chop`` is a last place whose documents are cut in ``pieces`` pieces of its length,
    for as many packs in turn."""

    count: int
    places: list[Place] = field(default_factory=list)
    chop: Place | None = None
    pieces: int = 1

    @property
    def used(self) -> int:
        return sum(p.length for p in self.places) + (self.chop.length if self.chop else 0)

    def split(self, n: int) -> tuple["Pattern", "Pattern | None"]:
        """The first ``n`` packs, and the others if there are any."""
        rest = Pattern(self.count - n, [p.later(n) for p in self.places]) if n < self.count else None
        return Pattern(n, self.places), rest


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[Pattern]:
    """Whole rests, longest first, each in the shortest pack if it fits there; ties to the older pattern."""
    packs: list[tuple[int, int, Pattern]] = []
    age = 0

    def keep(pattern: Pattern | None) -> None:
        nonlocal age
        if pattern is not None:
            age += 1
            heapq.heappush(packs, (pattern.used, age, pattern))

    for rest in sorted((r for r, n in histogram.items() if n), reverse=True):
        first, left = 0, histogram[rest]
        while left:
            if packs and packs[0][0] + rest <= length:
                pattern, others = packs[0][2].split(min(left, packs[0][2].count))
                heapq.heappop(packs)
                keep(others)
                n, each = pattern.count, 1
            else:
                # A new pack is the shortest, and the only one with room, until it is full of this rest.
                each = min(length // rest, left)
                pattern = Pattern(left // each)
                n = pattern.count
            keep(Pattern(n, [*pattern.places, *[Place(rest, first + i * n, 0, rest) for i in range(each)]]))
            first += n * each
            left -= n * each
    return [p for _, _, p in sorted(packs, key=lambda x: x[:2])]


def fill_up(patterns: list[Pattern], length: int, slack: int = 0) -> list[Pattern]:
    """The same ids with the shortest packs opened and their documents moved into the next shortest ones, cut where
    needed: as many packs as leave at most ``slack`` tokens of padding, or less than a sequence of it."""
    out = [p for p in patterns if not padding(p.used, length)]
    short = sorted((p for p in patterns if padding(p.used, length)), key=lambda p: p.used)
    total = sum(p.count * padding(p.used, length) for p in short)
    opened = min(total // length, max(-(-(total - slack) // length), 0))
    moving: deque[tuple[Place, int]] = deque()
    takers: deque[Pattern] = deque()
    for p in short:
        n = min(opened, p.count)
        opened -= n
        giver, rest = p.split(n) if n else (Pattern(0), p)
        moving.extend((place, n) for place in giver.places)
        if rest:
            takers.append(rest)
    # What a step leaves over waits behind, so that large groups meet large groups.
    while moving:
        place, n = moving.popleft()
        taker = takers.popleft()
        room = length - taker.used
        pieces = min(max(place.length // room, 1), taker.count)
        docs = min(n, taker.count // pieces)
        if docs < n:
            moving.appendleft((place.later(docs), n - docs))
        taker, rest = taker.split(docs * pieces)
        if rest:
            takers.appendleft(rest)
        moved = Place(place.rest, place.first, place.start, min(place.length, room))
        gone = pieces * moved.length
        if gone < place.length:
            moving.append((Place(place.rest, place.first, place.start + gone, place.length - gone), docs))
        if pieces > 1:
            out.append(Pattern(taker.count, taker.places, moved, pieces))
        elif moved.length == room:
            out.append(Pattern(taker.count, [*taker.places, moved]))
        else:
            takers.append(Pattern(taker.count, [*taker.places, moved]))
    return [*out, *takers]


class Plan:
    """Patterns as sorted arrays: which places the document of a rest and rank goes to."""

    def __init__(self, patterns: list[Pattern]):
        by_rest: dict[int, list] = {}
        sequence = 0
        for p in patterns:
            offset = 0
            for place in p.places:
                by_rest.setdefault(place.rest, []).append((place, p.count, 1, sequence, offset))
                offset += place.length
            if p.chop:
                by_rest.setdefault(p.chop.rest, []).append((p.chop, p.count // p.pieces, p.pieces, sequence, offset))
            sequence += p.count
        keys, starts, table = [], [], []
        for rest in sorted(by_rest):
            # Pieces of one document come from patterns whose ranks begin and end at other places.
            borders = sorted({b for place, n, *_ in by_rest[rest] for b in (place.first, place.first + n)})
            at = {b: i for i, b in enumerate(borders)}
            cells: list[list] = [[] for _ in borders]
            for place, n, pieces, base, offset in by_rest[rest]:
                rows = [
                    (place.start + i * place.length, place.length, base + i - pieces * place.first, pieces, offset) for i in range(pieces)
                ]
                for i in range(at[place.first], at[place.first + n]):
                    cells[i] += rows
            for border, cell in zip(borders[:-1], cells):
                keys.append(rest * RANKS + border)
                starts.append(len(table))
                table += sorted(cell)
        self.sequences = sequence
        self.keys = np.array(keys, np.int64)
        self.starts = np.array([*starts, len(table)], np.int64)
        self.table = np.array(table, np.int64).reshape(-1, 5)

    def places(self, rests: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start, length, sequence and offset of all pieces of the rests with these ranks."""
        cell = np.searchsorted(self.keys, rests * RANKS + ranks, side="right") - 1
        counts = self.starts[cell + 1] - self.starts[cell]
        row = np.repeat(np.arange(len(rests)), counts)
        upto = np.cumsum(counts) - counts
        start, size, shift, pieces, offset = self.table[np.arange(len(row)) - upto[row] + self.starts[cell][row]].T
        return row, start, size, shift + pieces * ranks[row], offset


def make_plan(histogram: dict[int, int], form: Packing, ids: int) -> Plan:
    """The plan for documents of ``ids`` ids in all."""
    return Plan(fill_up(shortest_pack_first(histogram, form.length), form.length, int(ids * form.slack)))


def _encoded(form: Packing):
    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(form.tokenizer)
        part = TaskContext.get().partitionId()
        seen, whole = np.zeros(form.length, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                rows = batch.slice(at, BATCH_TEXTS)
                ids, sizes = with_end(*encoder.encode(rows.column("text")), form.end_id)
                rests = sizes % form.length
                # The rank of a row among those of its rest in this task.
                order = np.argsort(rests, kind="stable")
                ordered = rests[order]
                runs = np.arange(len(rests)) - np.searchsorted(ordered, ordered)
                ranks = np.zeros(len(rests), np.int64)
                ranks[order] = runs
                ranks += seen[rests]
                seen += np.bincount(rests, minlength=form.length)
                full = sizes // form.length
                wholes = whole + np.cumsum(full) - full
                whole += int(full.sum())
                data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(np.full(len(sizes), part)), pa.array(sizes), pa.array(rests), pa.array(ranks), pa.array(wholes),
                        pa.array([data[e - 4 * n : e] for e, n in zip(ends, sizes.tolist())], pa.binary()),
                    ],
                    ["doc_id", "part", "doc_tokens", "rest", "rank", "whole", "ids"],
                )

    return encode


def encoded(docs: DataFrame, form: Packing) -> DataFrame:
    """The ids of every document, with its rest, its rank among those of the rest in its task, and the whole
    sequences of its task before it; written once, so ranks stay as they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, part long, doc_tokens long, rest long, rank long, whole long, ids binary"
    return staged(rows.mapInArrow(_encoded(form), schema), "packing-ids", compression="zstd")


def _pieces(form: Packing, plan: Plan):
    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rests, ranks, whole, shift, first = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_tokens", "rest", "rank", "whole", "_shift", "_first")
            )
            full = tokens // form.length
            row = np.repeat(np.arange(len(full)), full)
            nth = np.arange(len(row)) - (np.cumsum(full) - full)[row]
            some = np.flatnonzero(rests)
            at, start, size, sequence, offset = plan.places(rests[some], (ranks + shift)[some])
            at = some[at]
            rows = np.concatenate([row, at])
            starts = np.concatenate([nth * form.length, start + full[at] * form.length])
            sizes = np.concatenate([np.full(len(row), form.length), size])
            sequences = np.concatenate([plan.sequences + (first + whole)[row] + nth, sequence])
            offsets = np.concatenate([np.zeros(len(row), np.int64), offset])
            ids = [v.as_buffer() for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)), pa.array(starts), pa.array(sizes), pa.array(tokens[rows]),
                    pa.array(sequences), pa.array(offsets),
                    pa.array([ids[r][4 * a : 4 * (a + n)].to_pybytes() for r, a, n in zip(rows.tolist(), starts.tolist(), sizes.tolist())], pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return cut


def pack(docs: DataFrame, form: Packing) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit bytes) of every piece.

    Sequences are numbered from 0; pieces of one sequence lie without gaps from offset 0.
    """
    rows = encoded(docs, form)
    # At most form.length rows a task.
    counts = staged(rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / form.length)).alias("full"), F.sum("doc_tokens").alias("ids")), "packing-rests")
    found = counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).collect()
    plan = make_plan({r["rest"]: r["n"] for r in found if r["rest"]}, form, sum(r["ids"] for r in found))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task, and per task and rest.
    wholes = counts.groupBy("part").agg(F.sum("full").alias("full"))
    wholes = wholes.select(F.col("part").alias("_whole_part"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("_first"))
    shifts = counts.withColumn(
        "_shift", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    shifts = shifts.join(wholes, F.col("part") == F.col("_whole_part")).select(
        F.col("part").alias("_part"), F.col("rest").alias("_rest"), "_shift", "_first"
    )
    found = rows.join(broadcast_if_small(shifts), (F.col("part") == F.col("_part")) & (F.col("rest") == F.col("_rest")))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    found = found.select("doc_id", "doc_tokens", "rest", "rank", "whole", "_shift", "_first", "ids")
    return found.mapInArrow(_pieces(form, plan), schema)
