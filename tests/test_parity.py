"""Every registered query against its SQL on the small tables."""

import os

import pytest
from parity import compare, duck

import __spark_entry__ as entry

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
PLANS, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    if name in SQLS:
        assert compare(spark, con, SF, PLANS[name], SQLS[name]) == ""
    else:
        assert PLANS[name](spark, SF).schema.fields
