"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent.

A document is the average of learned vectors of hashed features, in three groups of equal weight:
its words, the character n-grams within them (with their borders), and the pairs of neighbouring
words. A pair is hashed by the exclusive or of its words, so it has no order and a word beside itself always
falls in the same bucket, whatever the word is. Softmax over the two labels gives the score.

Training takes a bounded sample of labelled rows, ``train_rows`` at most in expectation, chosen by a digest of
the id; every shard of it runs numpy SGD from the same model and the models are averaged, epoch by
epoch. Scoring covers every whole text: the trained model is one number per bucket and a bias, so a
text is three averages of looked-up numbers.

Defined results: a null or empty text has no features and scores by the bias alone; rows whose label is
null do not train; if a label has no training row every score is the share of label 1 (0.5 without rows);
repeated rows score alike; other columns are kept by ``scored``; a table's own ``score`` column is replaced.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.hashing import IS_SPACE, U, mixed, text_buffers, word_hashes
from labelmill.llm.memory import give_back, tidy
from labelmill.llm.text import extended
from labelmill.staging import staged


@dataclass(frozen=True)
class Training:
    """``buckets`` hashed vectors of ``dim`` numbers; n-grams of ``grams`` bytes; ``train_rows`` bounds the sample.

    Models are averaged ``rounds`` times; a sample of few rows is passed over more often, so that about
    ``steps`` steps are taken whatever its size.
    """

    buckets: int = 1 << 16
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    train_rows: int = 4000
    shards: int = 4
    rounds: int = 5
    steps: int = 20_000
    rate: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``weights`` is the log-odds a bucket adds when a document has nothing else."""

    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]


BLOCK_BYTES = 1 << 20
GROUPS = 3


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts with one space around each, white space as spaces; and the row of every byte."""
    offsets, data = text_buffers(column)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(column)), sizes)
    out = np.full(int(sizes.sum()) + len(column) + 1, 32, np.uint8)
    text = data[offsets[0] : offsets[-1]]
    places = np.arange(len(text)) + rows + 1
    out[places] = np.where(IS_SPACE[text], 32, text)
    row_of = np.zeros(len(out), np.int64)
    row_of[places] = rows
    return out, row_of


def features(column: pa.Array, grams: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all features of each group: words, n-grams, pairs."""
    words, rows = word_hashes(column, fold=False)
    pair = rows[1:] == rows[:-1]
    pairs, pair_rows = (words[1:] ^ words[:-1])[pair], rows[1:][pair]
    text, row_of = _padded(column)
    inside, wide = text != 32, text.astype(np.uint64)
    found, found_rows = [], []
    for n in grams:
        if len(text) < n:
            continue
        m = len(text) - n + 1
        valid = inside[1 : 1 + m].copy()
        for i in range(2, n - 1):
            valid &= inside[i : i + m]
        at = np.flatnonzero(valid)
        code = np.full(len(at), n, np.uint64)
        for i in range(n):
            code = (code << U(8)) | wide[at + i]
        found.append(mixed(code))
        found_rows.append(row_of[at + 1])
    grams_of = np.concatenate(found) if found else np.zeros(0, np.uint64)
    gram_rows = np.concatenate(found_rows) if found else np.zeros(0, np.int64)
    slot = lambda x, salt: (mixed(x + U(salt)) % U(buckets)).astype(np.int64)
    return [(slot(words, 1), rows.astype(np.int64)), (slot(grams_of, 2), gram_rows), (slot(pairs, 3), pair_rows.astype(np.int64))]


def blocks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of blocks of whole texts of about BLOCK_BYTES."""
    offsets, _ = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, column.slice(first, last - first)
        first = last


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """The score of every text."""
    out = []
    for _, part in blocks(column):
        logit = np.full(len(part), model.bias)
        for slots, rows in features(part, model.grams, len(model.weights)):
            sums = np.bincount(rows, model.weights[slots], minlength=len(part))
            logit += sums / np.maximum(np.bincount(rows, minlength=len(part)), 1) / GROUPS
        out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def _examples(how: Training):
    schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("label", pa.int32()), ("slots", pa.binary()), ("shares", pa.binary())])

    @tidy
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels = batch.column("key").to_pylist(), batch.column("label").to_pylist()
            for first, part in blocks(batch.column("text")):
                slots: list[list[np.ndarray]] = [[] for _ in range(len(part))]
                shares: list[list[np.ndarray]] = [[] for _ in range(len(part))]
                for found, rows in features(part, how.grams, how.buckets):
                    both, counts = np.unique(rows * how.buckets + found, return_counts=True)
                    at, total = both // how.buckets, np.bincount(rows, minlength=len(part))
                    edges = np.searchsorted(at, np.arange(len(part) + 1))
                    for i in range(len(part)):
                        a, b = edges[i], edges[i + 1]
                        slots[i].append((both[a:b] % how.buckets).astype(np.int32))
                        shares[i].append((counts[a:b] / max(total[i], 1) / GROUPS).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k % how.shards for k in keys[first : first + len(part)]], pa.int32()),
                        pa.array(keys[first : first + len(part)], pa.int64()),
                        pa.array(labels[first : first + len(part)], pa.int32()),
                        pa.array([np.concatenate(s).tobytes() for s in slots], pa.binary()),
                        pa.array([np.concatenate(s).tobytes() for s in shares], pa.binary()),
                    ],
                    schema=schema,
                )

    return examples


def start_model(how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Small random vectors, and the output layer with its bias last."""
    vectors = np.random.default_rng(how.seed).uniform(-1, 1, (how.buckets, how.dim)).astype(np.float32) / how.dim
    return vectors, np.zeros((2, how.dim + 1), np.float32)


def sgd_epoch(
    examples: list[tuple[int, np.ndarray, np.ndarray]], vectors: np.ndarray, output: np.ndarray, rate: float, balance: np.ndarray
) -> None:
    """One pass over (label, slots, shares), in place. ``balance`` weighs the labels."""
    for label, slots, shares in examples:
        hidden = np.append(shares @ vectors[slots], np.float32(1))
        logits = output @ hidden
        odds = np.exp(logits - logits.max())
        error = odds / odds.sum()
        error[label] -= 1
        error *= rate * balance[label]
        back = error @ output[:, :-1]
        output -= 0.1 * np.outer(error, hidden).astype(np.float32)
        # A slot's share of the average is its share of the step; the mean square share sets its size.
        # Where two groups hash to one slot, one of the two steps is taken.
        vectors[slots] -= np.outer(shares / (shares @ shares), back).astype(np.float32)


def _round(model, rate: float, balance: np.ndarray, passes: int):
    def epoch(key, frame):
        import pandas as pd

        vectors, output = (m.copy() for m in model.value)
        frame = frame.sort_values("key")
        rows = [
            (int(y), np.frombuffer(s, np.int32), np.frombuffer(w, np.float32))
            for y, s, w in zip(frame["label"], frame["slots"], frame["shares"])
        ]
        for _ in range(passes):
            sgd_epoch(rows, vectors, output, rate, balance)
        del frame
        give_back()
        return pd.DataFrame({"vectors": [vectors.tobytes()], "output": [output.tobytes()], "n": [len(rows)]})

    return epoch


def train(labelled: DataFrame, how: Training = Training()) -> Model:
    """``labelled`` has doc_id, text and label (0, 1 or null)."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("label").isin(0, 1)).select(
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(how.seed)), F.lit(1 << 30)).alias("key"), F.col("label").cast("int").alias("label"), "text"
    )
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.5
        return Model(np.zeros(1), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), how.grams)
    chosen = rows.where(F.col("key") < F.lit(int(min(1.0, how.train_rows / total) * (1 << 30))))
    examples = staged(
        chosen.mapInArrow(_examples(how), "shard int, key long, label int, slots binary, shares binary"), "examples"
    )
    balance = np.array([(total / 2 / counts[k]) ** 0.5 for k in (0, 1)])
    vectors, output = start_model(how)
    passes = math.ceil(how.steps / how.rounds / min(total, how.train_rows))
    for turn in range(how.rounds):
        model = spark.sparkContext.broadcast((vectors, output))
        run = _round(model, how.rate * (1 - turn / how.rounds), balance, passes)
        # A model per shard, whose number and size are fixed.
        done = examples.groupBy("shard").applyInPandas(run, "vectors binary, output binary, n long").collect()
        model.destroy()
        if not done:
            break
        weight = sum(r["n"] for r in done)
        vectors = sum(np.frombuffer(r["vectors"], np.float32).reshape(vectors.shape) * np.float32(r["n"] / weight) for r in done)
        output = sum(np.frombuffer(r["output"], np.float32).reshape(output.shape) * np.float32(r["n"] / weight) for r in done)
    toward = output[1] - output[0]
    return Model((vectors @ toward[:-1]).astype(np.float64), float(toward[-1]), how.grams)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the odds of label 1, from 0 to 1, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores(batch.column(text), shared.value))], [*batch.schema.names, "score"]
            )

    kept = docs.select(*names)
    return kept.mapInArrow(score, extended(kept.schema, score="double"))


def predicted(score: Column, threshold: float = 0.7) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)
