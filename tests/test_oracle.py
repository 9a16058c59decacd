"""Every registered query of the library against its SQL, on the smallest tables; and the driver's contract."""

import pytest

import __spark_entry__
from quire.plans import registry

from .compare import connect, differ

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert df.limit(1).count() == 1  # an empty result shows nothing
    if name in SQL:
        assert differ(df, con, SQL[name]) is None


def test_the_cases_are_in_the_data(spark, sf):
    """Runs that merge, spans of several rows: what the queries' SQL agrees on does occur."""
    assert QUERIES["j18_rowspan"](spark, sf).filter("span > 1").count() > 0
    merged = QUERIES["w9_merge_runs"](spark, sf)
    assert merged.filter("part like '%,%'").count() > 0 and merged.filter(r"part rlike '^.citep.[0-9]{2,}.$' and user_id % 2 = 0").count() > 0


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
