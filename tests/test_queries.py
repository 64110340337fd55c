"""Every core query against its SQL, or at least run, on the smallest tables."""

import pytest
from compare import connect, difference

from corpusloom.plans import catalog


@pytest.fixture(scope="session")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.SQL:
        assert difference(df, con, catalog.SQL[name]) == ""
    else:
        assert df.count() >= 0
    assert not [c for c, t in df.dtypes if t == "void"] or name == "validate_report"


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
