"""Every registered query against its SQL, on the smallest tables."""

import pytest

from figureyard.plans import registered
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None


FITS = ("ml3", "ml4", "ml5", "ml13")  # slow fits have their own tests


@pytest.mark.parametrize(
    "name",
    sorted(n for n in registered.QUERIES if n not in registered.SQL and not n.startswith(FITS)),
)
def test_query_without_sql_runs(spark, name):
    assert registered.QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["cls", "train", "val", "test"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
