"""Every registered query against its SQL counterpart, over the whole smallest tables."""

import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracle import compare, connect  # noqa: E402

from isobar.catalog.oracle import oracle_queries  # noqa: E402
from isobar.catalog.queries import QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
SQL = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0
