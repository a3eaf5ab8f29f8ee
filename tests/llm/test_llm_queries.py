"""Queries with a check in SQL, on the given tables."""

import pytest
from oracle import compare, duck

from corpusloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, sf_dir, name):
    error, n = compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
    assert error is None, error
    assert n > 0


def test_all_are_there():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
