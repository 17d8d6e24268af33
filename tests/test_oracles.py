"""Every query over the driver's tables against its DuckDB counterpart."""

import pytest

from odonymy import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(compare, name):
    compare(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_point_lists_every_query():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
