import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from compare import DATA, connect, same  # noqa: E402

from stepfree.llm.oracle import ORACLE  # noqa: E402
from stepfree.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs_over_whole_tables(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
