"""Queries that SQL can express, against DuckDB; and that the package is complete."""

import pytest

from checks.compare import compare, duck
from labelmill.llm import queries, sql

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(sql.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_result_as_sql(spark, name):
    ok, message = compare(spark, duck(SF), SF, name, queries.QUERIES[name], sql.ORACLES[name])
    assert ok, message
