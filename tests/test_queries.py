import pytest

from __spark_entry__ import CATALOGUES
from tests.oracle import DATA, connection, same

WITH_SQL = sorted(k for c in CATALOGUES for k in c.sql)
ALL = {k: q for c in CATALOGUES for k, q in c.queries.items()}
SQL = {k: s for c in CATALOGUES for k, s in c.sql.items()}


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    same(ALL[name](spark, DATA), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(WITH_SQL)))
def test_query_without_sql_runs(spark, name):
    assert ALL[name](spark, DATA).count() >= 0


def test_names_are_unique():
    assert len(ALL) == sum(len(c.queries) for c in CATALOGUES)
