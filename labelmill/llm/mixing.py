"""Mixing sources to target weights by capped water-filling.

Each source has a weight and may be repeated at most ``max_epochs`` times. The wanted number of
words is shared by weight; a source whose share exceeds its cap is clamped and the excess goes to
the others by weight, again and again until no share exceeds its cap. A source then takes its
documents ``floor(target / size)`` times whole, and a seeded part of them once more: documents are
dealt to buckets of bounded size, ordered by a keyed digest, and taken until the bucket's share of
words is reached. The document at that edge is taken in part, so a source's words come within
half a word per bucket of its target.

Only sizes and digests are shuffled. The chosen part of a bucket is a border in digest order, one
row per bucket, so texts find their repetitions by comparing with it and stay where they are.

Defined results: a null text has 0 words and takes none, and is repeated as often as its source is whole; a null source is a source of its own,
sorted last; rows that repeat an id and a size share the edge of a bucket evenly; an empty table
gives an empty result; other columns are kept by ``mixed_documents`` and dropped by ``mix``.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.text import WORD, word_count
from labelmill.operators.numbering import number_rows
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

# Documents in one sampling bucket; bounds what a task sorts, whatever a source's size.
BUCKET_ROWS = 8192


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order; ``epochs`` times all words are wanted."""

    weights: Sequence[int] = (3, 1, 2)
    epochs: float = 1.5
    max_epochs: float = 2.0
    seed: str = "mix"
    bucket_rows: int = BUCKET_ROWS


def seeded_key(doc_id: Column, seed: str) -> Column:
    """A 60-bit number from the seed and the id."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, size in words, and the seeded key."""
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), mix.seed).alias("key")
    )


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, docs, source_size, weight, target: the water-filling. ``sizes`` has source and size."""
    sums = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranked = number_rows(sums, [], [F.col("source").asc_nulls_last()], "rank", start=0)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    table = staged(
        ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(mix.weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(mix.max_epochs)))
        .drop("rank"),
        "mix-sources",
    )
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return table.withColumn("target", F.lit(0.0)).drop("cap")
    wanted, clamped, level = total * mix.epochs, -1, None
    rest_words, rest_weight = wanted, weight
    while True:
        # One row back to the driver per round. A round clamps at least one source more.
        level = rest_words / rest_weight
        over = F.col("cap") * F.lit(rest_weight) <= F.col("weight") * F.lit(rest_words)
        full, words, left = table.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if full == clamped or left == 0:
            break
        clamped, rest_words, rest_weight = full, wanted - words, left
    share = F.col("weight") * F.lit(rest_words) / F.lit(rest_weight)
    target = F.col("cap") if left == 0 else F.least(F.col("cap"), share)
    return table.withColumn("target", target).drop("cap")


def _placed(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Rows with their source's size and target, repetition rate and bucket."""
    side = broadcast_if_small(sources.drop("weight").withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("docs") / F.lit(mix.bucket_rows))
    place = F.floor(F.col("key").cast("double") / F.lit(float(1 << 60)) * buckets)
    return (
        rows.join(side, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.floor(rate))
        .withColumn("part", rate - F.floor(rate))
        .withColumn("bucket", F.least(place, buckets - 1))
        .drop("_source", "docs")
    )


def bucket_borders(placed: DataFrame) -> DataFrame:
    """Per bucket: the last key and size taken whole, and the edge taken in part with its words per row."""
    units = placed.groupBy("source", "bucket", "key", "size", "part").agg(F.count("*").alias("rows"))
    bucket = Window.partitionBy("source", "bucket")
    so_far = bucket.orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("rows")
    units = (
        units.withColumn("upto", F.sum(words).over(so_far))
        .withColumn("quota", F.floor(F.sum(words).over(bucket) * F.col("part") + 0.5))
        .withColumn("before", F.col("upto") - words)
    )
    at = F.struct("key", "size")
    edge = (F.col("before") < F.col("quota")) & (F.col("upto") > F.col("quota"))
    return units.groupBy("source", "bucket").agg(
        F.max(F.when(F.col("upto") <= F.col("quota"), at)).alias("last"),
        F.max(F.when(edge, at)).alias("edge"),
        F.max(F.when(edge, F.floor((F.col("quota") - F.col("before")) / F.col("rows")))).alias("share"),
    )


def _taken(placed: DataFrame, borders: DataFrame) -> DataFrame:
    """Add extra: words of the repetition that is not whole for all of the source."""
    side = broadcast_if_small(
        borders.withColumnsRenamed({"source": "_source", "bucket": "_bucket"})
    )
    at = F.struct("key", "size")
    extra = (
        F.when(at <= F.col("last"), F.col("size")).when(at == F.col("edge"), F.col("share")).otherwise(F.lit(0))
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))
    return (
        placed.join(side, same)
        .withColumn("extra", extra.cast("long"))
        .drop("_source", "_bucket", "last", "edge", "share", "bucket", "key", "part")
    )


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, extra and taken words of every document."""
    rows = staged(measured(docs, how), "mix-sizes")
    placed = _placed(rows, source_targets(rows, how), how)
    borders = staged(bucket_borders(placed), "mix-borders")
    return _taken(placed, borders).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def mixed_documents(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix itself: a row per repetition with the columns of ``docs``; an edge document's part is
    its first words joined by single spaces, with ``n_chars`` (if present) of that part."""
    rows = staged(measured(docs, how), "mix-sizes")
    sources = source_targets(rows, how)
    borders = staged(bucket_borders(_placed(rows, sources, how)), "mix-borders")
    held = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        "source",
        word_count(F.col("text")).alias("size"),
        seeded_key(F.col("doc_id"), how.seed).alias("key"),
    )
    taken = _taken(_placed(held, sources, how), borders)
    size, extra, whole = F.col("size"), F.col("extra"), F.col("whole").cast("int")
    # The words of each repetition: full ones, then the part if any.
    reps = F.concat(
        F.array_repeat(size, whole), F.when(extra > 0, F.array(extra)).otherwise(F.array().cast("array<bigint>"))
    )
    rows = taken.withColumn("_words", F.explode(reps))
    text = F.col("_doc.text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, F.col("_words").cast("int")), " ")
    cut = F.when(F.col("_words") < size, first).otherwise(text)
    out = {c: F.col("_doc")[c] for c in docs.columns} | {"text": cut}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_words") < size, F.length(first)).otherwise(F.col("_doc.n_chars")).cast(
            docs.schema["n_chars"].dataType
        )
    return rows.select(*[c.alias(n) for n, c in out.items()])
