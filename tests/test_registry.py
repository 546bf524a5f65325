import inspect

import pytest

import __spark_entry__ as contract
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(contract.queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 1


def test_no_cross_joins_in_the_library():
    import pkgutil

    import labelweave

    for info in pkgutil.walk_packages(labelweave.__path__, "labelweave."):
        source = inspect.getsource(__import__(info.name, fromlist=["_"]))
        assert ".crossJoin(" not in source and ".localCheckpoint(" not in source
