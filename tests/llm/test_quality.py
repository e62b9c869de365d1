import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelmill.llm import quality, queries
from labelmill.llm.text import crc_fold


def test_features_stay_in_words_and_rows():
    groups = quality.features(pa.array(["ab  cd", None, "", "ab ab"]), (3,), 1 << 20)
    words, grams, pairs = ([sorted(s[r == i].tolist()) for i in range(4)] for s, r in groups)
    # " ab", "ab " and the like: two n-grams of three bytes a word.
    assert [len(w) for w in words] == [2, 0, 0, 2] and [len(g) for g in grams] == [4, 0, 0, 4] and [len(p) for p in pairs] == [1, 0, 0, 1]
    assert words[3][0] == words[3][1] and words[3][0] in words[0]
    same = quality.features(pa.array(["x x", "yy yy"]), (3,), 1 << 20)[2][0]
    assert same[0] == same[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc_fold(r["doc_id"], 4) == 2) for r in rows)
    for label in (0, 1):
        of = [r for r in held if r["quality"] == label]
        assert sum(r["predicted"] == label for r in of) >= 0.95 * len(of)


def test_awkward_rows(spark, docs, no_docs):
    labelled = docs.select("doc_id", "text", F.when(F.col("doc_id") > 3, 1).when(F.col("doc_id") < 3, 0).alias("label"))
    model = quality.train(labelled, quality.Training(steps=50))
    got = quality.scored(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    bias = 1 / (1 + np.exp(-model.bias))
    assert all(abs(r["score"] - bias) < 1e-12 for r in rows if not (r["text"] or "").split())
    assert quality.scored(no_docs, model).count() == 0


def test_one_label_or_none(docs, no_docs):
    one = quality.train(docs.select("doc_id", "text", F.lit(1).alias("label")))
    assert all(r["score"] > 0.99 for r in quality.scored(docs, one).collect())
    none = quality.train(no_docs.select("doc_id", "text", F.lit(1).alias("label")))
    assert all(r["score"] == 0.5 for r in quality.scored(docs, none).collect())
