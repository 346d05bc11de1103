import os

import pytest

from statewright.operators import encode
from statewright.plans.queries import ORACLE_SQL, QUERIES

from .oracle import FOLDER, assert_equal, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no synthetic tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert_equal(spark, con, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["recurrent_component", "remove_transients", "lineitem_symbols", "multiline_counts", "strong_components"])
def test_equals_sql_where_tasks_rank_few_rows(spark, con, name, monkeypatch):
    monkeypatch.setattr(encode, "TASK_ROWS", 1000, raising=False)
    assert_equal(spark, con, QUERIES[name], ORACLE_SQL[name])
