"""Language identification by unigram pieces, summed over all segmentations.

A language is a probability for each piece of a fixed public vocabulary of byte strings. A word's probability
is the sum, over every way to cut it into pieces, of the product of their probabilities (the
forward algorithm), and a text's is the product over its words. Training is expectation maximisation: the
expected number of each piece over all segmentations of a language's words, from equal
probabilities, a fixed number of rounds.

Words are runs of letters in lower case behind a space, so pieces know the start of a word. Training
counts the words of a bounded sample of texts per language, chosen by a digest of the id; each round is a job
over the counted words that returns one number per piece and language, whatever the corpus is. The
model is that table. Scoring reads every whole text; a worker keeps the scores of words it has met in
a bounded cache, and computes new ones together, place by place, in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text when
nothing was learned; null languages do not train; words and pieces of any length count whole;
equal probabilities go to the first language in order; repeated rows score alike; a table's own
``lang_pred`` and ``score`` columns are replaced and other columns kept.
"""

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.memory import tidy
from labelmill.llm.text import extended
from labelmill.staging import staged

LETTERS = re.compile(r"[^\W\d_]+")
# Words cached by a worker, and places (bytes and ends of words) of one numpy pass; a longer word is a pass of its own.
CACHED_WORDS = 400_000
PASS_PLACES = 500_000
# A word whose sums fall below this is summed again as logarithms, which have no smallest number.
TINY = 1e-250
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """``vocabulary`` lists pieces as base64 and rank per line; ``train_docs`` bounds the sample of a language."""

    vocabulary: str
    train_docs: int = 4000
    rounds: int = 2
    floor: float = 0.01
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """log prior per language, and ``pieces`` x languages probabilities."""

    vocabulary: str
    languages: tuple[str, ...]
    prior: np.ndarray
    pieces: np.ndarray


def default_training() -> Training:
    import public_tokenizers

    return Training(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Pieces:
    """The vocabulary as an automaton over bytes (one character each)."""

    # No byte has this character, so no piece crosses it.
    BREAK = "Ā"

    def __init__(self, path: str):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.n = 0
        with open(path, "rb") as f:
            for line in f:
                if not line.strip():
                    continue
                piece = base64.b64decode(line.split()[0])
                if len(piece) > 255:
                    raise ValueError("a piece has over 255 bytes")
                self.automaton.add_word(piece.decode("latin-1"), (self.n << 8) | len(piece))
                self.n += 1
        self.automaton.make_automaton()

    def found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every piece in the words, in order of end and word; word lengths."""
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = self.BREAK.join([w.decode("latin-1") for w in words])
        hits = np.array([(end << 32) | value for end, value in self.automaton.iter(text)], np.int64)
        value = hits & 0xFFFFFFFF
        end = (hits >> 32) + 1
        word = np.searchsorted(starts, end - 1, side="right") - 1
        end = end - starts[word]
        order = np.lexsort((word, end))
        word, end, value = word[order], end[order], value[order]
        return word, end - (value & 0xFF), end, value >> 8, lengths


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


@dataclass(frozen=True)
class Sums:
    """How probabilities are added and multiplied, and what 0 and 1 are."""

    plus: np.ufunc
    times: np.ufunc
    zero: float
    one: float


PLAIN = Sums(np.add, np.multiply, 0.0, 1.0)
LOGS = Sums(np.logaddexp, np.add, -np.inf, 0.0)


def of_words(found, some: np.ndarray):
    """``found`` for the words at the places ``some``, given in order."""
    word, start, end, piece, lengths = found
    place = np.full(len(lengths), -1)
    place[some] = np.arange(len(some))
    kept = place[word] >= 0
    return place[word[kept]], start[kept], end[kept], piece[kept], lengths[some]


def forward(found, table: np.ndarray, how: Sums = PLAIN) -> np.ndarray:
    """words x places x languages: the sum over segmentations of each word up to each place."""
    word, start, end, piece, lengths = found
    sums = np.full((len(lengths), int(lengths.max()) + 1, table.shape[1]), how.zero)
    sums[:, 0] = how.one
    edges = np.searchsorted(end, np.arange(1, int(lengths.max()) + 2))
    for place in range(1, int(lengths.max()) + 1):
        a, b = edges[place - 1], edges[place]
        if a < b:
            at = _runs(word[a:b])
            ways = how.times(sums[word[a:b], start[a:b]], table[piece[a:b]])
            sums[word[a:b][at], place] = how.plus.reduceat(ways, at, axis=0)
    return sums


def backward(found, table: np.ndarray, how: Sums = PLAIN) -> np.ndarray:
    """words x places: the sum over segmentations of each word from each place, for a one-language table."""
    word, start, end, piece, lengths = found
    behind = np.full((len(lengths), int(lengths.max()) + 1), how.zero)
    behind[np.arange(len(lengths)), lengths] = how.one
    order = np.lexsort((word, -start))
    starts = -start[order]
    edges = np.searchsorted(starts, np.arange(-int(lengths.max()), 2))
    for i, place in enumerate(range(int(lengths.max()), -1, -1)):
        a, b = edges[i], edges[i + 1]
        if a < b:
            o = order[a:b]
            at = _runs(word[o])
            ways = how.times(behind[word[o], end[o]], table[piece[o], 0])
            # No piece starts at a word's end.
            behind[word[o][at], place] = how.plus.reduceat(ways, at)
    return behind


def expected(found, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected number of each piece in words met ``counts`` times, for a one-language table."""
    word, start, end, piece, lengths = found
    ahead, behind = forward(found, table)[:, :, 0], backward(found, table)
    whole = ahead[np.arange(len(lengths)), lengths]
    tiny = whole < TINY
    share = np.where(tiny, 0, counts / np.where(tiny, 1, whole))
    out = np.bincount(piece, ahead[word, start] * table[piece, 0] * behind[word, end] * share[word], minlength=len(table))
    if tiny.any():
        word, start, end, piece, lengths = few = of_words(found, np.flatnonzero(tiny))
        logs = np.log(table)
        ahead, behind = forward(few, logs, LOGS)[:, :, 0], backward(few, logs, LOGS)
        share = np.exp(ahead[word, start] + logs[piece, 0] + behind[word, end] - ahead[word, lengths[word]])
        out += np.bincount(piece, share * counts[tiny][word], minlength=len(table))
    return out


def word_logs(found, table: np.ndarray) -> np.ndarray:
    """words x languages: log probability of each word."""
    lengths = found[4]
    sums = forward(found, table)[np.arange(len(lengths)), lengths]
    tiny = np.flatnonzero((sums < TINY).any(axis=1))
    sums[tiny] = 1
    logs = np.log(sums)
    if len(tiny):
        logs[tiny] = forward(of_words(found, tiny), np.log(table), LOGS)[np.arange(len(tiny)), lengths[tiny]]
    return logs


def words_of(text: str) -> list[bytes]:
    """The letter runs of a text as a space and lower-case bytes."""
    return [b" " + w.encode() for w in LETTERS.findall(text.lower())]


def passes(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of ``words``, which ascend in length: each a numpy pass, in which all words get as many places as the longest."""
    first = 0
    while first < len(words):
        last = first + 1
        # Places grow along the list, so the end is found by halving.
        low, high = last, len(words)
        while low < high:
            middle = (low + high + 1) // 2
            if (middle - first) * (len(words[middle - 1]) + 1) <= PASS_PLACES:
                low = middle
            else:
                high = middle - 1
        yield first, low
        first = low


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), flushed whenever the counter is full."""
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["lang", "word", "n"],
        )
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for word, n in Counter(words_of(text.as_py() or "")).items():
                counts[lang, word] += n
            if len(counts) > CACHED_WORDS:
                yield flush()
    if counts:
        yield flush()


def _expect(model, languages: dict[str, int]):
    @tidy
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, table = model.value
        pieces, sums = pieces_of(path), {}
        for batch in batches:
            rows: dict[str, list] = {}
            for lang, word, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "word", "n")]):
                rows.setdefault(lang, []).append((word, n))
            for lang, some in rows.items():
                at = languages[lang]
                some.sort(key=lambda word: len(word[0]))
                words, counts = [w for w, _ in some], np.array([n for _, n in some], float)
                for a, b in passes(words):
                    got = expected(pieces.found(words[a:b]), table[:, at : at + 1], counts[a:b])
                    sums[at] = sums.get(at, 0) + got
        for at, got in sums.items():
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), at, np.int32)), pa.array(some.astype(np.int32)), pa.array(got[some])],
                ["lang", "piece", "n"],
            )

    return expect


def train(docs: DataFrame, how: Training) -> Model:
    """Learn from ``doc_id``, ``text`` and ``lang``."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull()).select(
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(how.seed)), F.lit(1 << 30)).alias("key"), "lang", "text"
    )
    # One row per language.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(counts))
    pieces = pieces_of(how.vocabulary)
    table = np.full((pieces.n, max(len(languages), 1)), 1 / pieces.n)
    if not languages:
        return Model(how.vocabulary, (), np.zeros(0), table)
    bound = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, int(min(1, how.train_docs / n) * (1 << 30)))])
    chosen = rows.where(F.col("key") < bound[F.col("lang")]).select("lang", "text")
    words = staged(
        chosen.mapInArrow(_count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words"
    )
    place = {lang: i for i, lang in enumerate(languages)}
    for _ in range(how.rounds):
        model = spark.sparkContext.broadcast((how.vocabulary, table))
        sums = words.mapInArrow(_expect(model, place), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        # At most one number per piece and language.
        got = sums.toArrow()
        model.destroy()
        fresh = np.full(table.shape, how.floor)
        fresh[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        table = fresh / fresh.sum(axis=0)
    total = sum(counts.values())
    return Model(how.vocabulary, languages, np.log([counts[l] / total for l in languages]), table)


class Scorer:
    """Log probabilities of words under every language, cached."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.vocabulary)
        self.place: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.place]
        if new and len(self.place) + len(new) > CACHED_WORDS:
            self.place, self.logs, new = {}, self.logs[:0], list(words)
        parts = [self.logs]
        # Words of like length share a pass.
        new.sort(key=len)
        for a, b in passes(new):
            parts.append(word_logs(self.pieces.found(new[a:b]), self.model.pieces))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.logs = np.concatenate(parts)

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its probability for each text."""
        bags = [Counter(words_of(t)) for t in texts]
        if self.model.languages:
            self.learn(set().union(*bags))
        names, sure = [], []
        for bag in bags:
            if not bag or not self.model.languages:
                names.append(UNKNOWN)
                sure.append(0.0)
                continue
            at = np.fromiter(map(self.place.__getitem__, bag), np.int64, len(bag))
            logs = self.model.prior + np.fromiter(bag.values(), np.float64, len(bag)) @ self.logs[at]
            best = int(logs.argmax())
            names.append(self.model.languages[best])
            sure.append(float(1 / np.exp(logs - logs[best]).sum()))
        return names, sure


_SCORERS: dict[int, Scorer] = {}


def identified(docs: DataFrame, model: Model, text: str = "text", slice_texts: int = 512) -> DataFrame:
    """``docs`` with ``lang_pred`` and its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            names, sure = [], []
            for at in range(0, batch.num_rows, slice_texts):
                got = scorer([t or "" for t in batch.column(text).slice(at, slice_texts).to_pylist()])
                names += got[0]
                sure += got[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    return kept.mapInArrow(identify, extended(kept.schema, lang_pred="string", score="double"))


def _scorer(shared) -> Scorer:
    """One scorer per Python worker and model, whose cache serves all of its tasks."""
    model = shared.value
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]
