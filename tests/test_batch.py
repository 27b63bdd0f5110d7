"""Every batch query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import DATA

from inkspark.plans.batch import QUERIES
from inkspark.plans.oracle import ORACLE

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, expected = duck_rows(con, ORACLE[name])
    assert sorted(df.columns) == sorted(columns)
    actual = spark_rows(df)
    assert sum(actual.values()) == sum(expected.values())
    assert actual == expected
