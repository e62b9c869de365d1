"""Folders of intermediate tables."""

import os

import pytest

from labelmill.staging import scratch, shared_dir, staged


def test_scratch_removes_what_was_made_inside(spark):
    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark) as folder:
        table = staged(spark.range(5).toDF("n"), "numbers")
        with scratch(spark):
            inner = staged(table.where("n > 2"), "few")
            assert inner.count() == 2 and shared_dir(spark).startswith(folder + "/")
        assert table.count() == 5 and all(folder in f for f in table.inputFiles())
        with pytest.raises(Exception):
            inner.count()
    assert set(os.listdir(shared_dir(spark))) == before


def test_scratch_goes_after_an_error(spark):
    before = set(os.listdir(shared_dir(spark)))
    with pytest.raises(ValueError), scratch(spark):
        staged(spark.range(5).toDF("n"), "numbers")
        raise ValueError
    assert set(os.listdir(shared_dir(spark))) == before
