"""Every registered query of the registry that has SQL gives the rows of that SQL."""

import pytest

from idloom.plans import case_queries, queries  # noqa: F401 its queries are registered on import
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.SQL[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
