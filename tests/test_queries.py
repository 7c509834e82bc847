import pytest

from eigenweave.plans.queries import ORACLES, QUERIES, flagship
from helpers import DATA_DIR, agrees


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert agrees(QUERIES[name](spark, DATA_DIR), ORACLES[name], DATA_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA_DIR).count() > 0


def test_flagship(spark):
    rows = flagship(spark, DATA_DIR).collect()
    assert len(rows) == 8 and all(len(r["loadings"]) == 64 for r in rows)


def test_entry_module():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
