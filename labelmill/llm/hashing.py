"""64-bit hashes of the words of whole text columns, computed on Arrow buffers."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes worked on at once; longer words make longer slices.
SLICE = 1 << 20
U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += U(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (one more than rows) and the bytes of a string column; null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _slices(offsets: np.ndarray, data: np.ndarray):
    """Byte ranges that end between words or rows."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + SLICE, end)
        if to < end:
            row = int(offsets[np.searchsorted(offsets, to)])
            probe = to
            while probe < row:
                spaces = np.flatnonzero(IS_SPACE[data[probe : min(probe + 4096, row)]])
                if len(spaces):
                    probe += int(spaces[0])
                    break
                probe = min(probe + 4096, row)
            to = probe
        yield at, to
        at = to


def segment_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [begin, end), which ascend and do not overlap; empty ones are alike."""
    lengths = end - begin
    out = np.zeros(len(begin), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        lengths = lengths[some]
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        values = data[np.repeat(begin[some], lengths) + within].astype(np.uint64)
        out[some] = np.add.reduceat(mixed(values + (within.astype(np.uint64) << U(8))), first)
    return mixed(out)


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the row of each. ``fold`` lower-cases A to Z.

    A word's hash sums a random number per byte and place, so different words collide with
    probability 2**-64.
    """
    offsets, data = text_buffers(column)
    hashes, rows = [], []
    table = LOWER if fold else np.arange(256, dtype=np.uint64)
    for lo, hi in _slices(offsets, data):
        part = data[lo:hi]
        inside = ~IS_SPACE[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        firsts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        firsts = firsts[firsts < len(part)]
        starts[firsts] = inside[firsts]
        begin = np.flatnonzero(starts)
        if not len(begin):
            continue
        places = np.flatnonzero(inside)
        first = np.searchsorted(places, begin)
        lengths = np.diff(np.append(first, len(places)))
        within = places - np.repeat(begin, lengths)
        values = mixed(table[part[places]] + (within.astype(np.uint64) << U(8)))
        hashes.append(mixed(np.add.reduceat(values, first)))
        rows.append((np.searchsorted(offsets, begin + lo, side="right") - 1).astype(np.int32))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``width`` words of one row; a row with fewer words is one run."""
    n = len(words)
    if not n:
        return words, rows
    with np.errstate(over="ignore"):
        run = np.zeros(max(n - width + 1, 0), np.uint64)
        for i in range(width):
            run = mixed(run + words[i : n - width + 1 + i]) if n >= width else run
        whole = rows[: len(run)] == rows[width - 1 :] if n >= width else np.zeros(0, bool)
        counts = np.bincount(rows)
        short = np.flatnonzero((counts > 0) & (counts < width))
        out, at = [run[whole]], [rows[: len(run)][whole]]
        if len(short):
            edges = np.concatenate([[0], np.cumsum(counts)])
            for row in short.tolist():
                value = np.zeros(1, np.uint64)
                for w in words[edges[row] : edges[row + 1]]:
                    value = mixed(value + w)
                # A run of fewer words must not equal a full one.
                out.append(mixed(value + U(counts[row])))
                at.append(np.array([row], rows.dtype))
    return np.concatenate(out), np.concatenate(at)
