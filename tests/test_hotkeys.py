"""Blocked windows must equal plain ones whatever the limit."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelmill.operators import hotkeys
from labelmill.operators.numbering import number_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        key = None if rng.random() < 0.05 else rng.choice(["hot"] * 6 + ["a", "b", "c", "d"])
        data.append((key, i, rng.choice([1, 2, 5]), rng.choice([None, None, "x", "y", "z"])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, seq long, n int, v string")


@pytest.mark.parametrize("limit", [1, 7, 50, 10**6])
def test_against_plain_windows(rows, limit):
    cut = hotkeys.cut_keys(rows, ["k"], "seq", limit)
    assert (cut.hot is None) == (limit == 10**6)
    out = hotkeys.row_number(rows, cut, ["seq"], "rn")
    out = hotkeys.running_sum(out, cut, ["seq"], F.col("n"), "total")
    out = hotkeys.previous_row(out, cut, ["seq"], ["n", "v"], "before")
    out = hotkeys.fill_forward(out, cut, ["seq"], {"filled": "v"})
    w = Window.partitionBy("k").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select(
        "*", F.row_number().over(w).alias("rn"), F.sum("n").over(run).alias("total"),
        F.lag(F.struct("n", "v")).over(w).alias("before"), F.last("v", ignorenulls=True).over(run).alias("filled"),
    )
    pick = ["k", "seq", "n", "v", "rn", "total", "before", "filled"]
    assert sorted(map(repr, out.select(*pick).collect())) == sorted(map(repr, plain.select(*pick).collect()))


def block_sizes(rows, cut):
    return sorted(r["count"] for r in cut.blocks(rows).groupBy("k", hotkeys.BLOCK).count().collect())


def test_blocks_are_equal_in_rows_for_a_burst_with_an_outlier(spark):
    rows = spark.createDataFrame([("k", i) for i in range(1000)] + [("k", 10**15)], "k string, at long")
    assert block_sizes(rows, hotkeys.cut_keys(rows, ["k"], "at", 100)) == [1] + [100] * 10


def test_one_moment_is_cut_by_the_rest_of_the_order(spark):
    rows = spark.createDataFrame([("k", 5, i) for i in range(40)], "k string, at long, tie int")
    cut = hotkeys.cut_keys(rows, ["k"], ["at", "tie"], 3)
    assert max(block_sizes(rows, cut)) == 3
    out = hotkeys.row_number(rows, cut, ["at", "tie"], "rn").collect()
    assert all(r.rn == r.tie + 1 for r in out)


def test_rows_alike_in_the_whole_order_stay_together(spark):
    rows = spark.createDataFrame([("k", 5, i) for i in range(40)], "k string, at long, tie int")
    assert block_sizes(rows, hotkeys.cut_keys(rows, ["k"], "at", 3)) == [40]


def test_a_far_copy_number_does_not_stretch_blocks(spark):
    from labelmill.operators import ingest

    rows = [("f", i, "x", "t", None, None) for i in range(60)] + [("f", 60, "x-dup999999999999", "t", None, None)]
    rows = spark.createDataFrame(rows, "file string, row_no long, id string, comment_text string, sentiment string, type string")
    out = ingest.dedupe_rows(rows, "file", "rename", limit=7).collect()
    assert sorted(r.source_id for r in out) == sorted(["x", "x-dup999999999999", *[f"x-dup{i}" for i in range(1, 60)]])


@pytest.mark.parametrize("group", [[], ["k"]])
def test_number_rows_is_contiguous(spark, rows, group):
    out = number_rows(rows, group, [F.col("n").desc(), "seq"], "id", start=10).collect()
    assert len(out) == 600
    groups = {}
    for r in out:
        groups.setdefault(r.k if group else 0, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (-r.n, r.seq))
        assert [r.id for r in members] == list(range(10, 10 + len(members)))
