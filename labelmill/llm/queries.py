"""The registered queries of this package: each operator over its whole table."""

import zlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import bitplanes, decontam, gridjoin, langid, mixing, ngramtrie, packing, periodic, prefixtrie, pseudonyms, quality, superminhash, warc
from labelmill.llm.deploy import ship
from labelmill.llm.text import fold_of
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    held_out = fold_of(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out).select("doc_id", "text", "lang"), langid.default_training())
    found = langid.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document, at most two epochs a source."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a deduplicated archive of the pages, read it back and resolve its revisits."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload")
    )
    path = warc.archive_folder(spark)
    warc.write_archives(warc.deduplicate(pages), path, date="2024-01-01T00:00:00Z")
    found = warc.resolve(
        warc.read_archives(spark, path),
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": F.when(F.col("payload").isNotNull(), warc.base32_sha1(F.col("payload"))),
        },
    )
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and quality label of the labelled rows outside the held-out fold."""
    one = labels.where(F.col("quality").isNotNull() & (fold_of(F.col("doc_id"), 4) != 2))
    one = one.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("label"))
    return docs.select("doc_id", "text").join(broadcast_if_small(one), F.col("doc_id") == F.col("_id")).drop("_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside one fold of four."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(labelled(docs, table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return quality.scored(rows, model).select(
        "doc_id", "held_out", "score", quality.predicted(F.col("score")).alias("predicted")
    )


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item within one edit per five words, with the item."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_gridjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine 0.93 or more within a label."""
    return gridjoin.similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the documents' token ids as byte planes and index them from the files."""
    path = bitplanes.ids_folder(spark)
    bitplanes.write_ids(table(spark, sf_dir, "documents"), path, bitplanes.default_format())
    return bitplanes.index_of(bitplanes.read_ids(spark, path))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts with numbers and dates replaced by their pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="corpus")


def op9_ngramtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a bigram model of four fifths of them, beside the unigram base."""
    held_out = fold_of(F.col("doc_id"), 5) == 1
    found = ngramtrie.scored(table(spark, sf_dir, "documents"), ~held_out)
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents by two-word shingles, similarity 0.8 or more."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), superminhash.Near(width=2))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 token ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.default_packing())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def with_repeats(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repeated tail that the id's digest asks for in one text of ten."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents' words, and digests of the list of runs and of the text without repeats."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), with_repeats)
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"),
        F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_shared_starts(conversations: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their hundred."""
    heads = conversations.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_head"))
    joined = conversations.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    shared = fold_of(F.col("conv_id"), 6).cast("int")
    turns = F.concat(
        F.coalesce(F.slice("_head", 1, shared), F.slice("turns", 1, 0)), F.slice("turns", shared + 1, F.size("turns"))
    )
    return joined.select("conv_id", turns.alias("turns"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared starts."""
    own = staged(prefixtrie.digested(table(spark, sf_dir, "conversations")), "conversations")
    return prefixtrie.trie(staged(with_shared_starts(own), "conversations"))


_QUERIES: dict[str, Query] = {
    "op1_langid": op1_langid, "op2_mixing": op2_mixing, "op3_warc": op3_warc, "op4_quality": op4_quality, "op5_decontam": op5_decontam,
    "op6_gridjoin": op6_gridjoin, "op7_bitplanes": op7_bitplanes,
    "op8_pseudonyms": op8_pseudonyms, "op9_ngramtrie": op9_ngramtrie,
    "op10_superminhash": op10_superminhash, "op11_packing": op11_packing, "op12_periodic": op12_periodic, "op13_prefixtrie": op13_prefixtrie,
}


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {name: _shipped(query) for name, query in _QUERIES.items()}
