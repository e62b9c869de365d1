"""Benchmark decontamination by pigeonhole edit matching over words.

A text holds a test item if some run of its words is within the item's error budget of word
edits (insertions, deletions, replacements). An item of n words with budget k is split in k + 1
pieces; k edits cannot touch all of them, so every match holds one piece exactly, at its place give or
take k words. All pieces of all items are found in one pass (an Aho-Corasick automaton over
lower-case words joined by single spaces), and the surroundings of each hit are verified with
Myers' bit-parallel distance, where one big integer holds a column of the distance matrix.

The items are a stated query set against all rows. They are sent to the tasks in blocks of a checked
size, one job per block; documents are read where they lie and nothing is shuffled.

Scripts that are written without spaces have a word per character. Items too short for an edit are searched as one
exact piece, beside other words as well.

Defined results: a null or empty text holds nothing; null and empty items are in nothing; an item under
``min_words`` words (a single word) is found only where it is the whole text; repeated items or rows are found again
for each; an empty benchmark finds nothing; other columns are kept by ``clean`` and dropped by ``matches``.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.memory import tidy
from labelmill.llm.text import extended

NOT_WORD = re.compile(r"\W+")
# Thai, Lao, Burmese, Khmer, Japanese syllables and Chinese characters.
UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\uff66-\uff9f\U00020000-\U0003ffff]"
)


@dataclass(frozen=True)
class Budget:
    """One edit for each full ``1 / rate`` words of an item. Items go out in blocks of ``block_bytes``."""

    rate: float = 0.2
    min_words: int = 2
    block_bytes: int = 16 << 20

    def edits(self, words: int) -> int:
        return int(words * self.rate + 1e-9)


def folded(text: str) -> str:
    """Lower-case words with one space before, between and after; a character of ``UNSPACED`` is a word."""
    text = text.lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \g<0> ", text)
    return " " + NOT_WORD.sub(" ", text).strip() + " "


def pieces(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """``edits`` + 1 runs that make up ``words``, with their places; sizes differ by one at most."""
    n = len(words)
    cuts = [i * n // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Distance of a pattern of words to the best run of a text, by bit-parallel columns."""

    def __init__(self, pattern: list[str]):
        self.size = len(pattern)
        self.at: dict[str, int] = {}
        for i, w in enumerate(pattern):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def best(self, text: list[str]) -> tuple[int, int]:
        """Smallest distance of any run, and the index after the first run that has it."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        best = (score, 0)
        for i, word in enumerate(text):
            equal = self.at.get(word, 0)
            xv = equal | down
            xh = (((equal & up) + up) ^ up) | equal
            more = (down | ~(xh | up)) & full
            less = up & xh
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            more, less = (more << 1) & full, (less << 1) & full
            up = (less | ~(xv | more)) & full
            down = more & xv
            if score < best[0]:
                best = (score, i + 1)
        return best


class Finder:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        import ahocorasick

        self.ids, self.patterns, self.edits, self.whole = [], [], [], {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = folded(text).split()
            if not words:
                continue
            if len(words) < budget.min_words:
                self.whole.setdefault(" ".join(words), []).append(item)
                continue
            at, edits = len(self.ids), budget.edits(len(words))
            self.ids.append(item)
            self.patterns.append(Myers(words))
            self.edits.append(edits)
            for place, piece in pieces(words, edits):
                found.setdefault(f" {' '.join(piece)} ", []).append((at, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.some = bool(found)

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item, edits, words before the match's end) of every item in the text."""
        flat = folded(text)
        out = [(item, 0, flat.count(" ") - 1) for item in self.whole.get(flat.strip(), ())]
        if not self.some:
            return out
        starts: dict[int, set[int]] = {}
        seen = words_before = 0
        for end, (length, owners) in self.automaton.iter(flat):
            begin = end - length + 1
            # Hits come by end, so a hit's begin may lie before the last one's.
            words_before += flat.count(" ", seen, begin) if begin >= seen else -flat.count(" ", begin, seen)
            seen = begin
            for at, place in owners:
                starts.setdefault(at, set()).add(words_before - place)
        if not starts:
            return out
        words = flat.split()
        for at, begins in starts.items():
            edits, pattern = self.edits[at], self.patterns[at]
            best, reach = None, None
            for begin in [*sorted(begins), None]:
                window = None if begin is None else (max(begin - edits, 0), begin + pattern.size + edits)
                if reach and window and window[0] <= reach[1]:
                    reach = (reach[0], max(reach[1], window[1]))
                    continue
                if reach:
                    distance, stop = pattern.best(words[reach[0] : reach[1]])
                    if distance <= edits and (best is None or distance < best[0]):
                        best = (distance, reach[0] + stop)
                reach = window
            if best:
                out.append((self.ids[at], *best))
        return out


def blocks_of(items: DataFrame, budget: Budget) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``block_bytes``; one list is on the driver at a time."""
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-size // budget.block_bytes))
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        yield list(zip(some["item_id"].to_pylist(), some["text"].to_pylist()))


_FINDERS: dict[int, tuple[object, Finder]] = {}


def _finder(shared) -> Finder:
    """One finder per Python worker and block of items."""
    value = shared.value
    if id(value) not in _FINDERS:
        _FINDERS.clear()
        # The block is kept as well, so that no other takes its place in memory and its finder with it.
        _FINDERS[id(value)] = (value, Finder(*value))
    return _FINDERS[id(value)][1]


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("end_word", pa.int64())])


def matches(docs: DataFrame, items: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """doc_id, item_id, edits and end_word (words up to the match's end) per text and item that it holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for block in blocks_of(items, budget):
        shared = docs.sparkSession.sparkContext.broadcast((block, budget))

        @tidy
        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared)
            for batch in batches:
                rows = [
                    {"doc_id": doc.as_py(), "item_id": item, "edits": edits, "end_word": end}
                    for doc, text in zip(batch.column("doc_id"), batch.column("text"))
                    for item, edits, end in finder(text.as_py() or "")
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FOUND)

        found = texts.mapInArrow(find, "doc_id long, item_id long, edits int, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    for block in blocks_of(items, budget):
        shared = docs.sparkSession.sparkContext.broadcast((block, budget))

        @tidy
        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared)
            for batch in batches:
                yield batch.filter(pa.array([not finder(t.as_py() or "") for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(keep, extended(docs.schema))
    return docs
