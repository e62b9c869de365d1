"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, token files.

Every stage is one operator of ``labelmill.llm`` over all that the stage before kept. All but the last
return the columns of documents. The first learns quality from the ``labels`` outside one fold
of four and drops the documents it rejects (score below 0.7); the second keeps one row, of the smallest id, of each group
of near duplicates (five word shingles, similarity 0.8 or more); the third drops documents that hold a
benchmark item; the fourth repeats, keeps or leaves out documents so that sources meet their target
weights; the last writes the token ids of what is left and returns the document index of the files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import bitplanes, decontam, mixing, quality, superminhash
from labelmill.llm.deploy import ship
from labelmill.llm.queries import labelled, table
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Columns that stages read.
READ = ("doc_id", "text", "source")


def carrying(stage: Stage) -> Stage:
    """A stage that gets all columns but those of ``READ`` under other names, so that none meets one of an operator's own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run


@carrying
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as empty ones. Every row is scored by itself, so rows that repeat an id or a text
    stay or go alike. An empty table gives an empty one; without labels nothing is learned and no row is accepted.
    """
    ship(spark)
    model = quality.train(labelled(docs, table(spark, sf_dir, "labels")))
    scored = quality.scored(docs, model)
    return scored.where(quality.predicted(F.col("score")) == 1).select(*docs.columns)


@carrying
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest id, a null id if there is no other.

    Ids may be repeated or null, so decisions are on rows: each has a number of its own, written with it. Null and
    empty texts are copies of nothing and stay; an empty table gives an empty one.
    """
    ship(spark)
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = superminhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_found"), F.col("component_id").alias("_component"))
    found = staged(
        found.join(rows.select("_row", "doc_id"), F.col("_found") == F.col("_row")).select("_row", "doc_id", "_component"), "groups"
    )
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = found.groupBy("_component").agg(F.min(first)["_row"].alias("_kept")).select("_kept")
    # The rows to drop are fewer than those to keep.
    dropped = found.join(kept, F.col("_row") == F.col("_kept"), "left_anti").select(F.col("_row").alias("_dropped"))
    return rows.join(broadcast_if_small(dropped), F.col("_row") == F.col("_dropped"), "left_anti").select(*docs.columns)


@carrying
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, texts of any length are searched whole, rows that repeat an id are judged
    by their own texts, and an empty table or benchmark changes nothing.
    """
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, an edge document's part with ``n_chars`` of that part.

    A null source is a source of its own; rows without words take no room in the mix; rows that repeat an id are
    documents of their own, ties between them being settled by size; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document index of the token files written from the mix.

    Null and empty texts have the end id only; repeated rows are written as often as they come; null ids are first;
    an empty table gives an empty index.
    """
    ship(spark)
    path = bitplanes.ids_folder(spark)
    bitplanes.write_ids(docs, path, bitplanes.default_format())
    return bitplanes.index_of(bitplanes.read_ids(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

# A learned classifier, signatures, edit matching and a tokenizer: SQL cannot express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
