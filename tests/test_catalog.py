"""Every registered query of the library against its SQL twin on the smallest tables."""

import compare
import pytest

from feedlens import catalog


@pytest.fixture(scope="module")
def con(small):
    return compare.duck(small)


#: Nothing is flagged or due on so few rows.
MAY_BE_EMPTY = {"feed_last_calls", "filter_roles", "paced_queue"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, small, name):
    said = compare.differs(spark, con, small, catalog.QUERIES[name], catalog.ORACLES[name])
    assert said == "" or said == "no rows" and name in MAY_BE_EMPTY, said


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
