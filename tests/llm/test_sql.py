"""Queries of the pipeline's operators against their SQL."""

from __future__ import annotations

import pytest
from run_all import compare, duck

from bequest.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    assert compare(QUERIES[name](spark, FOLDER).toArrow(), duck(FOLDER).sql(ORACLES[name]).to_arrow_table()) is None
