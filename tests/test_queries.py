"""Every registered query against its SQL; those without SQL give rows. And the registry holds together."""

import pytest

import __spark_entry__ as entry
from gridweave.plans import queries_compose, queries_more, queries_range, registry

from .conftest import TESTDATA, same

SF = str(TESTDATA / "sf0.001")
OWN = {**queries_range.QUERIES, **queries_more.QUERIES, **queries_compose.QUERIES}
SQL = {**queries_range.ORACLE_SQL, **queries_more.ORACLE_SQL, **queries_compose.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(OWN) <= set(entry.queries())


def test_every_row_of_the_registry_has_a_query_and_an_implementation():
    for row in registry.ROWS.values():
        assert row.query in OWN, row.name
        assert row.is_valid(), row.name
        assert row.implemented(), row.name


def test_edge_modes_have_queries_of_their_own():
    """Each mode beyond a row's first is shown by a query with SQL."""
    for row in registry.ROWS.values():
        for edge in row.edges[1:]:
            names = {f"{row.query}_{edge.lower()}", f"{row.query.removesuffix('_lookback')}_{edge.lower()}", f"{row.query}_inside"}
            if row.family in (registry.Family.RANGE, registry.Family.HIST) and row.name not in NO_QUERY:
                assert names & set(SQL), (row.name, edge)


#: Its only query is in the mode ANCHOR.
NO_QUERY = {"state_duration_over_time"}
