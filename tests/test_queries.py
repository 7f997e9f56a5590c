"""Every core query against its SQL on the smallest tables."""

import pytest
from conftest import canonical

from papyrine.plans import oracle, queries, service

SQL = {**oracle.oracle_sql(), **service.oracle_sql()}
QUERIES = {**queries.queries(), **service.queries()}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got) > 0 and not got.isna().all().any()
