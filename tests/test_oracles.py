"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, difference, type_difference
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    frame = QUERIES[name](spark, sf_dir)
    relation = connection.sql(ORACLES[name])
    assert type_difference(frame, relation) is None
    ours = frame.toPandas()
    assert len(ours) > 0
    assert difference(ours, relation.df()) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_the_contract_functions(spark):
    assert entry_module.queries().keys() >= QUERIES.keys()
    assert entry_module.oracle_sql().keys() >= ORACLES.keys()
    assert entry_module.entry(spark).count() == 32
