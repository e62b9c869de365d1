"""Token ids of whole text columns, equal to a tokenizer's own, as flat arrays.

A tokenizer always breaks at certain places, so texts are cut there, pieces are known by 64-bit
hashes, and the ids of repeated pieces come from a bounded table. Two kinds of tokenizer files are
known: byte-level ones that keep white space, cut before a single space between two other
characters, around a single line feed, and between a letter and a closing mark; and ones that drop white space and
lower case, cut at white space and before a closing mark. Any other tokenizer encodes texts whole.

Nulls are empty texts. A text with other white space beside a space, or with a special token's
string, is encoded whole.
"""

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from labelmill.llm.hashing import IS_SPACE, U, segment_hashes, text_buffers

# Pieces whose ids a worker keeps, about 20 bytes each.
KNOWN_PIECES = 1_500_000
FRESH_PIECES = 30_000
KNOWN_IDS = 16_000_000
LEARNED_AT_ONCE = 4096
SLICE_BYTES = 400_000
# How byte-level vocabularies write a space.
SPACE = "Ġ"
# Tells a piece without a space before it from the same one with it.
BARE = U(0x9D39247E33776D41)
IS_MARK = np.zeros(256, bool)
IS_MARK[[ord(c) for c in ".,;:!?"]] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
ODD = -1


class Known:
    """Ids of pieces by hash: a large sorted table, a small one that is merged into it, and a pool of ids."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.tables = [self._empty(), self._empty()]
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    @staticmethod
    def _empty():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.tables)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is known, and where its ids start and how many they are (ODD: not to be used alone)."""
        known = np.zeros(len(names), bool)
        starts, counts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int32)
        for keys, begin, count in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == names)
                known[hit] = True
                starts[hit], counts[hit] = begin[at[hit]], count[at[hit]]
        return known, starts, counts

    def add(self, names: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New hashes in ascending order; ``ids`` holds the ids of all in turn."""
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), self.kind)])
        self.pool[self.used : need] = ids
        lengths = np.maximum(counts, 0)
        rows = names, (self.used + np.cumsum(lengths) - lengths).astype(np.uint32), counts.astype(np.int32)
        self.used = need
        self.tables[1] = self._merged(self.tables[1], rows)
        if len(self.tables[1][0]) > FRESH_PIECES:
            self.tables = [self._merged(*self.tables), self._empty()]

    @staticmethod
    def _merged(a, b):
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))


class PieceEncoder:
    """``encode(column)`` gives the ids of all rows in turn and the number of ids of each row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pieces = self.tokenizer.get_vocab()
        self.vocabulary = max(pieces.values()) + 1
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.keeps_space, self.drops_space = _keeps_space(spec), _drops_space(spec)
        if self.keeps_space:
            self.spaced = np.zeros(self.vocabulary, bool)
            self.spaced[[i for piece, i in pieces.items() if piece.startswith(SPACE)]] = True
            # White space beside a space, or a special token, among pieces joined by spaces.
            self.odd = re.compile("|".join([r"\s ", r" \s", r"\s$", *map(re.escape, self.special)]))
        if self.drops_space:
            # One id that seldom occurs parts the pieces of a joined text.
            self.parting = next(c for c in "§¶©#" if len(self._ids(c)) == 1)
            self.parting_id = int(self._ids(self.parting)[0])
        self.known = Known(self.kind)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = text_buffers(column)
        ids, counts, first = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], 0
        while first < len(column):
            # Texts of a few megabytes at a time bound what is held.
            last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
            last = min(max(last, first + 1), len(column))
            some = self._rows(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            ids.append(some[0])
            counts.append(some[1])
            first = last
        return np.concatenate(ids), np.concatenate(counts)

    def _whole(self, text: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        raw = text.tobytes()
        texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in rows.tolist()]
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not len(text):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64)
        if not (self.keeps_space or self.drops_space):
            ids = self._whole(text, offsets, np.arange(rows))
            return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)
        if self.drops_space:
            folded = FOLD[text]
            # Special tokens are found before lower case.
            text = text if self.specials.search(folded.tobytes().decode()) else folded
            begin, end, edges = cut_words(text, offsets)
            bare = np.zeros(len(begin), bool)
        else:
            begin, end, bare, edges = cut_spaced(text, offsets)
        if not len(begin):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64)
        names = segment_hashes(text, begin, end)
        names[bare] ^= BARE
        found, at, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_PIECES or self.known.used > KNOWN_IDS:
            self.known.clear()
        new = np.flatnonzero(~self.known.find(found)[0])
        if len(new):
            self._learn(found[new], text, begin[at[new]], end[at[new]], bare[at[new]])
        _, starts, counts = self.known.find(found)
        lengths = np.maximum(counts, 0).astype(np.int64)[inverse]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.known.pool[np.repeat(starts[inverse] - upto[:-1], lengths) + np.arange(upto[-1])]
        borders = upto[edges]
        sizes = np.diff(borders)
        odd = np.flatnonzero(counts == ODD)
        if len(odd):
            where = np.flatnonzero(np.isin(inverse, odd))
            again = np.unique(np.searchsorted(edges, where, side="right") - 1)
            parts, done = [], 0
            for row, own in zip(again.tolist(), self._whole(text, offsets, again)):
                parts += [ids[done : borders[row]], own]
                done = borders[row + 1]
                sizes[row] = len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, sizes

    def _learn(self, names: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, bare: np.ndarray) -> None:
        raw = text.tobytes()
        words = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]
        counts = np.full(len(words), ODD, np.int64)
        if self.drops_space:
            usable = np.ones(len(words), bool)
            groups = [(np.arange(len(words)), self._parted)]
        else:
            usable = np.ones(len(words), bool)
            if self.odd.search(" " + " ".join(words)):
                usable[:] = [_stands_alone(w, self.specials, b) for w, b in zip(words, bare.tolist())]
            groups = [(np.flatnonzero(usable & ~bare), self._after_space), (np.flatnonzero(usable & bare), self._singly)]
        ids, places = [], []
        for rows, encode in groups:
            # The tokenizer holds a few hundred bytes for each byte that it is given at once.
            for some in (rows[at : at + LEARNED_AT_ONCE] for at in range(0, len(rows), LEARNED_AT_ONCE)):
                flat, counts[some] = encode([words[i] for i in some.tolist()])
                ids.append(flat)
                places.append(some)
        # Back to the order of the hashes.
        flat = np.concatenate(ids) if ids else np.zeros(0, self.kind)
        order = np.concatenate(places) if places else np.zeros(0, np.int64)
        sizes = counts[order]
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        lengths = np.maximum(counts, 0)
        upto = np.cumsum(lengths)
        self.known.add(names, counts, flat[np.repeat(starts - (upto - lengths), lengths) + np.arange(int(lengths.sum()))])

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for row in ids for i in row], self.kind), np.array([len(i) for i in ids], np.int64)

    def _after_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words behind a space. All are one text, in which only a word's first id starts with a space."""
        ids = self._ids(" " + " ".join(words))
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(words):
            raise ValueError("the tokenizer does not break before every space")
        return ids, np.diff(np.append(at, len(ids)))

    def _parted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words between white space. All are one text with a parting word between them."""
        if not self.specials.search("\n".join(words)):
            ids = self._ids(f" {self.parting} ".join(words))
            here = ids == self.parting_id
            at = np.flatnonzero(here)
            if len(at) == len(words) - 1:
                edges = np.concatenate([[-1], at, [len(ids)]])
                return ids[~here], np.diff(edges) - 1
        return self._singly(words)


def _keeps_space(spec: dict) -> bool:
    splitter = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space")
    )


def _drops_space(spec: dict) -> bool:
    """Lower case without context, and a split whose pieces are letters, single digits, or neither, never white space."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in first.get("pattern", {}).get("Regex", "")
    )


def _stands_alone(word: str, specials: re.Pattern, bare: bool) -> bool:
    if bare and word == "\n":
        return True
    return word != "" and not word[0].isspace() and not word[-1].isspace() and not specials.search(word)


def _closing_marks(text: np.ndarray, offsets: np.ndarray, at_end: np.ndarray) -> np.ndarray:
    """Places of one closing mark behind an ASCII letter of its row, before a place of ``at_end``."""
    marks = np.flatnonzero(IS_MARK[text] & at_end[1:])
    return marks[(marks > 0) & IS_LETTER[text[np.maximum(marks - 1, 0)]] & ~np.isin(marks, offsets)]


def cut_words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all pieces between white space, and the first piece of each row (one more than rows)."""
    inside = ~IS_SPACE[text]
    at_end = np.zeros(len(text) + 1, bool)
    at_end[:-1] = ~inside
    at_end[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[offsets < len(text)]
    starts[firsts] = inside[firsts]
    starts[_closing_marks(text, offsets, at_end)] = True
    begin = np.flatnonzero(starts)
    # A piece ends where the next begins, or at the white space or row end before that.
    stop = np.flatnonzero(at_end)
    end = np.minimum(stop[np.searchsorted(stop, begin, side="right")], np.append(begin[1:], len(text)))
    return begin, end, np.searchsorted(begin, offsets)


def cut_spaced(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all pieces, whether each has no space before it, and the first piece of each row."""
    gaps = np.flatnonzero(text == 32)
    filled = np.flatnonzero(np.diff(offsets))
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    # A line feed between two characters other than white space, beyond ASCII taken as such, is a piece.
    feeds = np.flatnonzero(text == 10)
    feeds = feeds[(feeds > 0) & (feeds < len(text) - 1) & ~edge[feeds] & ~edge[feeds + 1]]
    plain = ~IS_SPACE[text] & (text > 32) & (text < 127)
    feeds = feeds[plain[feeds - 1] & plain[feeds + 1]]
    last = edge.copy()
    last[gaps] = True
    last[feeds] = True
    marks = _closing_marks(text, offsets, last)
    # Where places tie, an empty piece at a row's end comes before the next row's first.
    begin = np.concatenate([gaps + 1, offsets[filled], marks, feeds, feeds + 1])
    order = np.argsort(begin, kind="stable")
    bare = (np.arange(len(begin)) >= len(gaps))[order]
    begin = begin[order]
    end = np.sort(np.concatenate([offsets[filled + 1], gaps, marks, feeds, feeds + 1]), kind="stable")
    starts = order.argsort(kind="stable")[len(gaps) : len(gaps) + len(filled)]
    edges = np.full(len(offsets), len(begin))
    edges[filled] = starts
    # An empty row has no pieces.
    edges = np.minimum.accumulate(edges[::-1])[::-1]
    return begin, end, bare, edges


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file, whose table serves all of its tasks."""
    return PieceEncoder(path)
