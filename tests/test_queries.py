"""Every registered query against its SQL, on the smallest tables, and what all plans must keep to."""

from pathlib import Path

import pytest

from cellweave.queries import all_queries
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()
USER_FUNCTIONS = {"u1_user_function", "u2_named_inputs_function", "u4_user_function_with_helpers"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    """The rows of the SQL; no product of unkeyed sides; Python only in user functions."""

    def check_plan(plan):
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        if name not in USER_FUNCTIONS:
            assert "Python" not in plan and "InPandas" not in plan

    assert compare(spark, con, QUERIES[name], SF_DIR, check_plan) is None


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
