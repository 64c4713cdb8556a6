"""Every catalog query against its SQL counterpart on the smallest generated tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from run_all import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from bequest.catalog.queries import CATALOG

FOLDER = "/root/testdata/sf0.001"
NAMES = list(CATALOG)


@pytest.fixture(scope="module")
def results(spark):
    runs = queries()

    def run(name):
        try:
            return runs[name](spark, FOLDER).toArrow()
        except Exception as error:  # noqa: BLE001
            return error

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES)))


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(NAMES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, results, con):
    result = results[name]
    if isinstance(result, Exception):
        raise result
    assert compare(result, con.sql(oracle_sql()[name]).to_arrow_table()) is None


def test_entry(spark):
    result = entry(spark)
    assert result.columns[:2] == ["will_id", "beneficiary_id"]
    assert result.count() > 0
