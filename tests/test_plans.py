"""What the physical plans must and must not hold."""

import pytest

from checks.tables import Tables
from labelmill.operators import filters, media, quality
from labelmill.plans import reports

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_scans_are_pruned_and_filtered(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(10).selectExpr(
        "string(id) comment_id", "'d' dataset_id", "'t' text", "'pending' status", "'x' sentiment", "'en' type"
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    text = plan(quality.count_by_status(filters.filter_comments(rows, dataset_id="d", status="pending")))
    assert "EqualTo(dataset_id,d)" in text and "EqualTo(status,pending)" in text
    assert "ReadSchema: struct<dataset_id:string,status:string>" in text


def test_no_python_and_no_cross_joins(tables):
    for df in (
        reports.dataset_report(tables.datasets, tables.comments, tables.versions),
        reports.global_overview(tables.comments, tables.datasets, tables.users),
        media.dataset_stats(tables.media_datasets, tables.assets, tables.annotations),
        quality.activity_by_dataset(tables.versions, tables.comments),
    ):
        text = plan(df)
        for word in ("EvalPython", "Cartesian", "NestedLoop"):
            assert word not in text, (word, text[:2000])


def test_report_reads_texts_once(spark, tables, monkeypatch):
    written = []
    stage = reports.staged
    monkeypatch.setattr(reports, "staged", lambda df, name: written.append(plan(df)) or stage(df, name))
    final = plan(reports.dataset_report(tables.datasets, tables.comments, tables.versions))
    assert len(written) == 1 and "text" in written[0] and "hashpartitioning" not in written[0]
    assert "text:string" not in final


def test_counts_fold_before_the_shuffle(tables):
    text = plan(quality.near_duplicate_count(tables.comments))
    assert text.count("partial_count(1)") >= 1 and "partial_sum" in text


def test_rank_limits_run_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan(media.recent_work_by_user(tables.annotations, 5))


def test_page_is_a_top_k(tables):
    from labelmill.operators.paging import page

    assert "TakeOrderedAndProject" in plan(page(tables.comments, "comment_id"))
