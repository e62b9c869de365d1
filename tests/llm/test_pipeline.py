import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelmill.llm import queries, superminhash
from labelmill.staging import staged

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_on_their_own_input(spark):
    docs = queries.table(spark, SF, "documents")
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), "stage")
        assert out.columns == columns
        results.append((docs, out))
        docs = out
    (first, accepted), (_, single), (_, clean), (_, mixed) = results
    labels = queries.table(spark, SF, "labels")
    left = accepted.join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in left}.get(0, 0) <= 2
    lost = first.join(accepted, "doc_id", "left_anti").join(labels.where("quality = 1"), "doc_id").count()
    assert lost <= 5
    found = superminhash.near_duplicates(accepted)
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in found.where("kept").select("doc_id").collect())
    words = lambda t: " ".join(t.lower().split())
    items = [words(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    assert not [r["doc_id"] for r in clean.collect() if any(i in words(r["text"]) for i in items)]
    assert mixed.select("doc_id").distinct().count() <= clean.count() < mixed.count()


def test_run(spark):
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    assert rows and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(rows, rows[1:]))


def test_one_row_of_each_group_of_repeated_and_null_ids(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [
        (1, words("a")), (2, words("a") + " x"), (2, words("b")), (3, words("c")), (3, words("c")),
        (None, words("a")), (None, words("d")), (None, words("d")), (4, None), (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    want = [(1, words("a")), (2, words("b")), (3, words("c")), (None, words("d")), (4, None), (4, None)]
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, docs, name, stage):
    """Nulls, repeats, long and empty texts, beside real documents; column names that operators use themselves."""
    real = queries.table(spark, SF, "documents").limit(400)
    both = real.unionByName(docs.select(*real.columns))
    own = ["score", "_row", "_found", "_dropped", "label", "size", "taken", "predicted", "bucket", "target", "doc"]
    both = staged(both.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce("text", F.lit("none"))) for c in own}), "awkward")
    out = stage(spark, both, SF)
    assert out.columns == both.columns
    rows = out.collect()
    assert rows
    for r in rows:
        was = r["score"].removeprefix("score-")
        assert all(r[c] == f"{c}-{was}" for c in own)
        # The mix takes the first words of a document at its edge.
        assert was == ("none" if r["text"] is None else r["text"]) or name == "mixing" and was.split()[: len(r["text"].split())] == r["text"].split()
    texts = {r["text"] for r in rows if r["doc_id"] in (4, 5, 6)}
    if name in ("near_duplicates", "decontamination"):
        assert {None, "", " \t\n "} <= texts


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_empty_tables(spark, no_docs, name, stage):
    assert stage(spark, no_docs, SF).collect() == []
