from collections import defaultdict

from pyspark.sql import functions as F

from labelmill.llm import mixing, queries
from labelmill.llm.mixing import Mix


def fill(sizes: dict, how: Mix) -> dict:
    """Water-filling by hand, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: how.weights[i % len(how.weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = how.epochs * sum(sizes.values()) - sum(how.max_epochs * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and how.max_epochs * sizes[s] < left * weight[s] / share}
        if not over:
            return {s: how.max_epochs * sizes[s] if s in full else left * weight[s] / share for s in order}
        full |= over


def test_targets_and_words(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    how = Mix(bucket_rows=16)
    rows = mixing.mix(docs, how).collect()
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    by_hand = fill(dict(sizes), how)
    for s in sizes:
        assert abs(want[s] - by_hand[s]) < 1e-6 * max(1, by_hand[s])
        assert abs(taken[s] - want[s]) <= 1 + 0.5 * len(rows) / 16
    again = mixing.mix(docs.repartition(7), how).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents_are_the_taken_words(docs):
    how = Mix()
    taken = defaultdict(int)
    for r in mixing.mix(docs, how).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs, how)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_empty_and_wordless(docs, no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed_documents(no_docs).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}
