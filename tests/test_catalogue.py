"""Every catalogue query against its SQL, and the driver's contract."""

from functools import cache

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from concordat.plans import catalogue, catalogue_sql, layers, layers_sql, records, records_sql


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.fixture(scope="module")
def shared_layers():
    """The written tables of a run serve all its queries, to save time."""
    own = layers.layers, layers.graph
    layers.layers, layers.graph = cache(own[0]), cache(own[1])
    yield
    layers.layers, layers.graph = own


@pytest.mark.parametrize("name", sorted(catalogue_sql.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(con, catalogue_sql.ORACLES[name], catalogue.QUERIES[name](spark, sf)) > 0


@pytest.mark.parametrize("name", sorted(records_sql.ORACLES))
def test_record_query_matches_sql(spark, sf, con, name):
    assert compare(con, records_sql.ORACLES[name], records.QUERIES[name](spark, sf)) > 0


@pytest.mark.parametrize("name", sorted(layers_sql.ORACLES))
def test_layer_query_matches_sql(spark, sf, con, shared_layers, name):
    assert compare(con, layers_sql.ORACLES[name], layers.QUERIES[name](spark, sf)) > 0


def test_every_core_query_has_sql():
    for queries, sql in ((catalogue, catalogue_sql), (layers, layers_sql), (records, records_sql)):
        assert set(queries.QUERIES) == set(sql.ORACLES)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["group_id", "action_key", "a_id", "b_id"] and df.count() == 242
