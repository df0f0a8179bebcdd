"""Every query that has SQL gives the same rows in both engines; the rest runs."""

import os

import pytest

from compare import connect, differences
from fixloom.plans import curation, general, origins

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = general.QUERIES | curation.QUERIES | origins.QUERIES, general.SQL | curation.SQL | origins.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert differences(spark, con, QUERIES[name], SQL[name], FOLDER) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_projects_are_not_sorted_into_one_task(spark):
    plan = general.project_totals(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    plan = curation.QUERIES["collapse_commit"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
