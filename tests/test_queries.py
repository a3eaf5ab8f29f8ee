"""Every registered query against its SQL check on the smallest given tables."""

import pytest
from oracle import compare, duck

from corpusloom.plans import registry

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    error, n = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE.get(name), sf_dir)
    assert error is None, error
    assert n >= 0


def test_every_operator_is_covered():
    """Each operator of the inventory has a query, or is a job tested on its own."""
    covered = {op for ops in registry.COVERS.values() for op in ops}
    tested_elsewhere = {"OP-005"}  # reading files
    assert {f"OP-{i:03d}" for i in range(1, 106)} - covered - tested_elsewhere == set()


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["query_id", "rank"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
