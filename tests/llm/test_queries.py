"""Queries of the training-data operators against their SQL."""

import pytest

from figureyard.llm import registered
from tests.compare import connect, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_matches_sql(spark, name):
    df = registered.QUERIES[name](spark, FOLDER)
    found = connect(FOLDER).execute(registered.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, df.collect()) == normal(columns, found.fetchall())


def test_entry_lists_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(registered.QUERIES) | {"pipeline"} <= names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
