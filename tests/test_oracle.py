"""Every query of the library against its SQL."""

import pytest

import __spark_entry__ as entry
from siltworks import queries as own
from tests.oracle import duck, same_rows


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_query_matches_sql(spark, small, con, name):
    same_rows(own.QUERIES[name](spark, small), con, own.ORACLE[name])


def test_every_query_has_sql():
    assert set(own.QUERIES) == set(own.ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_samples_repeat(spark, small):
    first, second = (sorted(r.value for r in own.QUERIES["sample_numeric"](spark, small).collect()) for _ in range(2))
    assert first == second
