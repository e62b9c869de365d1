"""Runs of words that repeat with a period, by online dyadic square catching.

A square is a stretch of words followed by itself. Squares of period p in [2B - 1, 4B - 2] are caught by
blocks of B = 2**level words: their first half holds a block that begins at a multiple of B, and the
block occurs again p words later. So for each level a catcher stands on every completed block. Words are
appended in any portions; an appended portion completes fingerprints of B words (each from two of B / 2), and
each new one is compared with the two blocks whose catchers wait for it. Equal fingerprints in
consecutive blocks of one period are one chain: a square that grows as words come. When a chain breaks, its run
is less than a block longer on both sides, which comparisons of ever shorter suffixes and prefixes find.
Chains of one stretch at several multiples of its period merge into the run of the smallest.

Each appended word costs a few operations a level, on numpy arrays, so a batch of texts is appended
as one, texts parted by words of their own. Fingerprints have 64 bits.

Defined results: a null text has no words; rows that repeat an id are texts of their own; a null id is an empty name
where an id's digest is needed; an empty table gives an empty result; other columns are not read. A text of n words takes
about 8 log2(n) bytes a word while it is worked on.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.hashing import U, mixed
from labelmill.llm.memory import tidy
from labelmill.llm.text import utf8

MIN_EXPONENT = 4
MIN_WORDS = 6
# Words worked on at once; a longer text is worked on alone.
PORTION = 1 << 17
BATCH_TEXTS = 256
TURN = U(0x9E3779B97F4A7C15)


class Catchers:
    """Online runs of a growing sequence of words, given as 64-bit names.

    ``min_exponent`` (2 or more) is the least length of a run in periods, ``min_words`` its least length;
    ``longest_period`` bounds the periods looked for.
    """

    def __init__(self, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS, longest_period: int | None = None):
        self.min_exponent, self.min_words, self.longest_period = min_exponent, min_words, longest_period
        # Fingerprints of 2**level words from each place; chains by level: blocks checked, and where each period's chain began.
        self.prints = [np.zeros(0, np.uint64)]
        self.checked: list[int] = []
        self.chains: list[np.ndarray] = []
        self.found: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.prints[0])

    def append(self, words: np.ndarray) -> None:
        """Words follow; chains that they break become runs."""
        self.prints[0] = np.concatenate([self.prints[0], words.astype(np.uint64)])
        self._advance(False)

    def finish(self) -> np.ndarray:
        """Start, end and period of all runs, by start and period, once no words follow."""
        self._advance(True)
        runs = np.concatenate(self.found) if self.found else np.zeros((0, 3), np.int64)
        # One stretch has its smallest period only.
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        first = np.ones(len(runs), bool)
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[first]
        size = runs[:, 1] - runs[:, 0]
        runs = runs[(size >= self.min_exponent * runs[:, 2]) & (size >= self.min_words)]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]

    def _links(self, block: int) -> int:
        """Whole blocks that meet their copies in a run of the least length, whatever its place."""
        least = (self.min_exponent - 1) * (2 * block - 1)
        return max((least - block + 1) // block, 1)

    def _advance(self, last: bool) -> None:
        n, level = len(self), 0
        longest = n // self.min_exponent
        if self.longest_period is not None:
            longest = min(longest, self.longest_period)
        while 2 * (1 << level) - 1 <= longest:
            block = 1 << level
            if level == len(self.prints):
                self.prints.append(np.zeros(0, np.uint64))
            if level == len(self.chains):
                self.chains.append(np.full(2 * block, -1, np.int64))
                self.checked.append(0)
            if level:
                half, done = self.prints[level - 1], len(self.prints[level])
                upto = n - block + 1
                if upto > done:
                    a, b = half[done : upto], half[done + block // 2 : upto + block // 2]
                    self.prints[level] = np.concatenate([self.prints[level], mixed(a * TURN + b)])
            self._check(level, last)
            level += 1

    def _check(self, level: int, last: bool) -> None:
        """Compare the fingerprints of newly completed rows of a block with those of the blocks that wait for them."""
        block, prints = 1 << level, self.prints[level]
        begin, end = self.checked[level], len(prints) // block
        if last:
            end = -(-len(prints) // block)
        chains = self.chains[level]
        # Column r of row c is place c * block + r. It is compared with the blocks ``back`` and ``back`` + 1 rows before
        # its own row, so a column stands for one period.
        rows = prints[begin * block : end * block]
        there = np.arange(begin * block, end * block) < len(prints)
        rows = np.pad(rows, (0, len(there) - len(rows))).reshape(-1, block)
        there = there.reshape(-1, block)
        columns = np.arange(block)
        for i, more in enumerate((0, 1)):
            back = np.where(columns == block - 1, 1, 2) + more
            same = np.zeros((len(rows) + 1, block), bool)
            for distance in {int(back[0]), int(back[-1])}:
                own = np.flatnonzero(back == distance)
                at = np.arange(begin, end) - distance
                ok = at >= 0
                waiting = prints[np.maximum(at, 0) * block]
                part = slice(int(own[0]), int(own[-1]) + 1)
                same[:-1, part] = (rows[:, part] == waiting[:, None]) & ok[:, None] & there[:, part]
            state = chains[i * block : (i + 1) * block]
            open_before = state >= 0
            # Where a chain begins and where it breaks; the last row of ``same`` breaks all when nothing follows.
            before = np.vstack([open_before[None, :], same[:-1]])
            after = same if last else same[:-1]
            before = before if last else before[:-1]
            begins, breaks = np.nonzero((after & ~before).T), np.nonzero((before & ~after).T)
            first = [np.flatnonzero(open_before), begins[0]]
            column = np.concatenate(first)
            row = np.concatenate([state[first[0]], begins[1] + begin])
            order = np.lexsort((row, column))
            column, row = column[order], row[order]
            # Begins and breaks of a column alternate; an open chain has no break yet.
            broken = np.zeros(block, np.int64)
            np.add.at(broken, breaks[0], 1)
            place = np.arange(len(column)) - np.searchsorted(column, column)
            closed = place < broken[column]
            stops = breaks[1] + begin
            self._close(level, column[closed], row[closed], stops, back)
            state[:] = -1
            state[column[~closed]] = row[~closed]
        self.checked[level] = end

    def _close(self, level: int, column: np.ndarray, first: np.ndarray, stop: np.ndarray, back: np.ndarray) -> None:
        """Runs of the chains that hold enough blocks: rows ``first`` to ``stop`` of a column match."""
        block = 1 << level
        long = stop - first >= self._links(block)
        column, first, stop = column[long], first[long], stop[long]
        if not len(column):
            return
        period = column + back[column] * block
        # Words x and x - period are equal for x from low to high.
        low, high = first * block + column, stop * block + column
        low = low - self._common(low, low - period, level, -1)
        high = high + self._common(high, high - period, level, 1)
        runs = np.stack([low - period, high, period], axis=1)
        self.found.append(runs[high - low >= (self.min_exponent - 1) * period])

    def _common(self, x: np.ndarray, y: np.ndarray, level: int, way: int) -> np.ndarray:
        """Words, less than a block, that the suffixes before (``way`` -1) or the prefixes behind ``x`` and ``y`` share."""
        n, done = len(self), np.zeros(len(x), np.int64)
        for step in range(level - 1, -1, -1):
            size = 1 << step
            prints = self.prints[step]
            a, b = (x + done, y + done) if way > 0 else (x - done - size, y - done - size)
            ok = (a + size <= n) & (b >= 0) & (b + size <= n) & (a >= 0)
            same = ok & (prints[np.where(ok, a, 0)] == prints[np.where(ok, b, 0)])
            done[same] += size
        return done


def runs_of(words: np.ndarray, **limits: int) -> np.ndarray:
    """Start, end and period of all runs of one sequence of names."""
    catchers = Catchers(**limits)
    catchers.append(words)
    return catchers.finish()


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are outside all runs or in the first period of each run that holds them."""
    dropped = np.zeros(n + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    return np.cumsum(dropped[:-1]) == 0


def names_of(words: list[bytes], known: dict[bytes, int]) -> list[int]:
    """Numbers of words, equal for equal words."""
    return [known.setdefault(w, len(known)) for w in words]


def _batches_of(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like sizes, together at most a portion of words or one row."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    ordered, begin = sizes[order], 0
    upto = np.cumsum(ordered)
    while begin < len(order):
        # Rows of up to twice the first one's words share levels.
        end = int(np.searchsorted(ordered, 2 * ordered[begin], side="right"))
        fits = int(np.searchsorted(upto, upto[begin] - ordered[begin] + PORTION, side="right"))
        end = min(end, max(fits, begin + 1))
        yield order[begin:end]
        begin = end


def runs_of_all(texts: list[np.ndarray], **limits: int) -> list[np.ndarray]:
    """``runs_of`` every sequence, whose names are below 2**62."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for rows in _batches_of(sizes):
        # A word of its own between texts ends every run.
        parts = [x for i, r in enumerate(rows.tolist()) for x in (texts[r].astype(np.uint64), np.array([(1 << 62) + i], np.uint64))]
        catchers = Catchers(longest_period=int(sizes[rows].max()) // limits.get("min_exponent", MIN_EXPONENT), **limits)
        catchers.append(mixed(np.concatenate(parts)))
        runs = catchers.finish()
        ends = np.cumsum(sizes[rows] + 1)
        which = np.searchsorted(ends, runs[:, 0], side="right")
        begins = ends - sizes[rows] - 1
        cut = np.searchsorted(which, np.arange(len(rows) + 1))
        for i, r in enumerate(rows.tolist()):
            if cut[i] < cut[i + 1]:
                mine = runs[cut[i] : cut[i + 1]].copy()
                mine[:, :2] -= begins[i]
                out[r] = mine
    return out


def _digests(change):
    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BATCH_TEXTS) for whole in batches for at in range(0, whole.num_rows, BATCH_TEXTS)):
            ids = batch.column("doc_id")
            # Equal words of a batch have equal numbers.
            known: dict[bytes, int] = {}
            texts = [t.split() for t in utf8(batch.column("text"))]
            if change:
                texts = [change(words, i) for words, i in zip(texts, ids.to_pylist())]
            found = runs_of_all([np.array(names_of(words, known), np.int64) for words in texts])
            rows = []
            for words, runs in zip(texts, found):
                listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs.tolist())
                kept = [words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()] if len(runs) else words
                best = min(((a - b, a, q) for a, b, q in runs.tolist()), default=None)
                rows.append((len(words), runs, best, listed, b" ".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([r[2] and r[2][1] for r in rows], pa.int64()),
                    pa.array([r[2] and -r[2][0] for r in rows], pa.int64()),
                    pa.array([r[2] and r[2][2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"],
            )

    return digest


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length and period (null without runs), ``runs`` (a line
    'start,length,period' each) and ``collapsed``, the text with every run cut to its first period.

    Words are numbered from 0. ``change(words, doc_id)`` may alter a text's words before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, runs string, collapsed string"
    return rows.mapInArrow(_digests(change), schema)

