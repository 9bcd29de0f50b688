import importlib

import pytest

from apertura.plans import catalogue, catalogue_sql


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_what_its_sql_gives(name, same_as_sql):
    same_as_sql(catalogue.queries()[name], catalogue_sql.oracle_sql()[name])


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "o_orderkey"
