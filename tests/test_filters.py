import random
from datetime import datetime


import pytest
from pyspark.sql import functions as F

from labelmill.operators import filters, paging, quality
from labelmill.operators.vocabulary import check_labels, scope_to_user, valid_options

T0 = datetime(2026, 2, 1)


@pytest.fixture(scope="module")
def comments(spark):
    data = [
        ("1", "A", "r1", "great product", "positive", "bangla", "annotated", None, 0), ("2", "A", "r2", "bad", "negative", "bangla", "pending", "u1", 1),
        ("3", "A", "r3", "meh", "neutral", "english", "pending", None, 2), ("4", "A", "r4", "x" * 120, "positive", "bangla", "pending", None, 3),
        ("5", "B", "only", "solo", None, "english", None, "u2", 4),
    ]
    df = spark.createDataFrame(data, "comment_id string, dataset_id string, source_id string, text string, sentiment string, type string, status string, assigned_to string, s int")
    return df.withColumn("created_at", F.timestamp_seconds(F.lit(1769904000) + F.col("s"))).drop("s")


@pytest.mark.parametrize(
    "query,ids",
    [
        ({"search": " GREA "}, "1"), ({"status": "annotated", "exclude_annotated": True}, "1"), ({"exclude_annotated": True}, "2345"),
        ({"dataset_ids": []}, ""), ({"dataset_ids": ["A"], "dataset_id": "B"}, ""), ({"dataset_ids": ["A", "B"], "dataset_id": "B"}, "5"),
        ({"assigned_to": None}, "134"), ({"assigned_to": "u1"}, "2"), ({"ids": ["2", "9"]}, "2"), ({"source_id": "r3"}, "3"),
        ({"search": "x" * 120}, "4"), ({"search": "x" * 150}, ""), ({"type": "english", "sentiment": "neutral"}, "3"), ({"search": "   "}, "12345"),
    ],
)
def test_comment_filter(comments, query, ids):
    assert "".join(sorted(r.comment_id for r in filters.filter_comments(comments, **query).collect())) == ids


def test_pages_agree_shallow_and_deep(comments, monkeypatch):
    order = [("type", "asc"), ("created_at", "desc")]
    shallow = [r.comment_id for n in (1, 2, 3) for r in paging.page(comments, "comment_id", n, 2, order).collect()]
    monkeypatch.setattr(paging, "TOP_K_ROWS", 0)
    deep = [r.comment_id for n in (1, 2, 3) for r in paging.page(comments, "comment_id", n, 2, order).collect()]
    assert shallow == deep == ["4", "2", "1", "5", "3"]
    assert paging.page_count(comments, 2).first()[:] == (5, 3)
    assert paging.page(comments, "comment_id", 4, 2, order).collect() == []
    with pytest.raises(ValueError):
        paging.page(comments, "comment_id", 0)


def test_quality_counts(comments):
    assert {r.label: r["count"] for r in quality.group_by_field(comments, "sentiment").collect()} == {"positive": 2, "negative": 1, "neutral": 1, None: 1}
    got = quality.count_by_status(comments).where("dataset_id = 'A'").first()
    assert (got.total, got.annotated, got.pending) == (4, 1, 3)
    hist = quality.length_histogram(comments.where("dataset_id = 'A'"), [0, 10, 50, 100]).orderBy("pos").collect()
    assert [(r.label, r["count"]) for r in hist] == [("0–9", 2), ("10–49", 1), ("100+", 1)]


def test_balance_figures(spark):
    counts = spark.createDataFrame([("d", "a", 30), ("d", "b", 10), ("d", None, 99), ("e", "a", 5)], "k string, label string, count long")
    got = {r.k: r for r in quality.summarize(counts, ["k"]).collect()}
    d, e = got["d"], got["e"]
    assert (d.total, d.classes, d.imbalance_ratio, d.entropy, d.max_entropy, d.balance_score, d.gini) == (40, 2, 3.0, 0.811, 1.0, 0.811, 0.375)
    assert (e.classes, e.entropy, e.max_entropy, e.balance_score, e.gini) == (1, 0.0, 0.0, 1.0, 0.0)


def test_near_copies_of_a_hot_text(spark):
    df = spark.range(3000).select(F.lit("d").alias("dataset_id"), F.when(F.col("id") % 3 == 0, " Same TEXT ").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    assert quality.near_duplicate_count(df).first().duplicate_count == 999


def test_vocabulary_checks(spark, comments):
    sets = spark.createDataFrame([("A", "t1", "u1"), ("B", "gone", "u2")], "dataset_id string, taxonomy_id string, assigned_to string")
    tax = spark.createDataFrame(
        [("t1", "T", [("positive", "Positive", 0.0)], [])], "taxonomy_id string, name string, sentiment array<struct<value:string,label:string,order:double>>, type array<struct<value:string,label:string,order:double>>"
    )
    options = valid_options(sets, tax)
    got = {r.dataset_id: (sorted(r.sentiments), len(r.types)) for r in options.collect()}
    assert got == {"A": (["positive", "unannotated"], 4), "B": (["negative", "neutral", "positive", "unannotated"], 4)}
    bad = {r.comment_id: r.bad_label for r in check_labels(comments, options).collect()}
    assert bad == {"1": None, "2": "sentiment", "3": "sentiment", "4": None, "5": None}
    assert scope_to_user(comments, sets, "u2").count() == 1 and scope_to_user(comments, sets, "u2", admin=True).count() == 5


def test_readiness_and_warnings(spark):
    from labelmill.plans.readiness import readiness, warnings

    rows = [
        ("none", 0, 0, 0, 0, 1.0, None, None, None, 0, 1.0, None, None, None),
        ("good", 600, 600, 0, 2, 0.9, 1.2, "a", "b", 2, 0.9, 1.2, "x", "y"),
        ("bad", 90, 9, 10, 1, 1.0, 1.0, "a", "a", 2, 0.4, 9.5, "x", "y"),
        ("mid", 400, 300, 20, 3, 0.6, 4.0, "a", "c", 1, 1.0, 1.0, "x", "x"),
    ]
    axis = "{0}_classes int, {0}_balance_score double, {0}_imbalance_ratio double, {0}_top string, {0}_bottom string"
    df = spark.createDataFrame(rows, "k string, total long, annotated long, duplicate_count long, " + axis.format("s") + ", " + axis.format("t"))
    got = {r.k: (r.r, r.w) for r in df.select("k", readiness().alias("r"), warnings().alias("w")).collect()}
    assert tuple(got["none"][0]) == ("empty", 0, ["Dataset has no comments."]) and got["none"][1] == []
    assert tuple(got["good"][0]) == ("ready", 100, ["Looks good — no obvious issues detected."])
    bad, warned = got["bad"]
    assert (bad.level, bad.score) == ("not_ready", 0)
    assert bad.reasons == [
        "Only 10.0% of comments are annotated (need ≥ 50% to even consider training).",
        "Only 90 comments — most text models need at least a few hundred.",
        "Sentiment has fewer than 2 classes — nothing to classify.",
        "Type/Language classes are imbalanced (balance score 0.4).",
        "10 near-duplicate comments (11.1%) — dedupe before training.",
    ]
    assert [tuple(w) for w in warned] == [
        ("type_imbalance", "high", 'Type "x" is 9.5× more common than "y".'),
        ("low_annotation_coverage", "high", "Less than half the dataset is annotated (9/90)."),
        ("near_duplicates", "high", "10 near-duplicate comments detected."),
    ]
    mid, warned = got["mid"]
    assert (mid.level, mid.score) == ("needs_work", 100 - 15 - 8 - 8 - 15 - 4)
    assert warned[0].severity == "medium" and warned[1].severity == "low"


def test_a_deep_page_reads_one_range(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "b", "c"]), rng.randrange(50), "wide " * 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, kind string, n int, body string")
    for sort in ([("kind", "asc"), ("n", "desc")], [("n", "desc")], [("kind", "desc")]):
        index = paging.PageIndex(df, "id", sort, ranges=20)
        want = [r.id for r in df.orderBy(*paging._order(sort), "id").collect()]
        for page, limit in ((1, 7), (90, 11), (200, 10), (182, 11), (3, 700)):
            assert [r.id for r in paging.page(df, "id", page, limit, sort, index).collect()] == want[(page - 1) * limit : page * limit]
        places = index.places(90, 11)
        opened = {f.rsplit("/", 2)[1] for f in places.inputFiles()}
        plan = places._jdf.queryExecution().executedPlan().toString()
        assert len(index.sizes.collect()) > 5 and "PartitionFilters: [" in plan and opened
        sizes = index.sizes.where("_before < 990 and _before + _n > 979").count()
        assert sizes <= 2 and "body" not in index.schema.names
    assert paging.PageIndex(df.where("id < 0"), "id", [("n", "asc")]).page(1, 5).collect() == []
