"""What the transitions move and what one task holds do not grow faster than the tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import codes

from bequest.catalog.queries import CATALOG
from bequest.operators import rules
from bequest.session import INPUT_PER_PARTITION, tune
from bequest.sources.tables import stored_bytes

FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FOUND = [
    (1, 11, 1, Decimal("5")),
    (2, 11, None, Decimal("5")),
    (3, None, 1, Decimal("5")),
    (4, 99, 1, Decimal("5")),
    (5, 11, 9, Decimal("5")),
    (6, 31, 1, Decimal("5")),
    (7, 71, 1, Decimal("5")),
    (7, 71, 1, Decimal("5")),
]


@pytest.fixture
def groupings(spark):
    """No broadcasts, so that every join of two tables shows its shuffles."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Aggregate") // 2
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch(spark):
    return spark.createDataFrame(FOUND, "seq long, asset_id long, beneficiary_id long, share_percent decimal(7,2)")


def test_share_requests_are_not_grouped(spark, estate, groupings):
    """A batch of pairs that hardly repeat is joined as it is, not as its distinct keys and then once more."""
    checked = rules.check_assignment_targets(batch(spark), estate["assets"], estate["wills"], estate["beneficiaries"])
    assert groupings(checked) == 0
    assert checked.count() == len(FOUND)
    assert codes(checked, "seq") == {1: None, 2: -21001, 3: -20010, 4: -21001, 5: -21002, 6: -21003, 7: None}


def test_transfer_requests_are_not_grouped(spark, estate, groupings):
    """Only shares and transfers are grouped, both in one table of pairs."""
    tables = [estate[n] for n in ("assets", "beneficiaries", "shares", "wills", "transfers")]
    checked = rules.check_transfers(batch(spark), *tables)
    assert groupings(checked) == 1
    assert checked.count() == len(FOUND)
    assert codes(checked, "seq") == {1: -23004, 2: -23001, 3: -23001, 4: -23001, 5: -23002, 6: -23004, 7: None}


def test_partitions_follow_the_input(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tune(spark, (least + 3) * INPUT_PER_PARTITION)
    assert spark.conf.get(FIRST) == str(least + 3)
    tune(spark)
    assert spark.conf.get(FIRST, None) is None
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_shares_are_derived_once(spark, tmp_path):
    day = datetime(1995, 3, 1)
    lines = [(o, o * 3 + k, k % 4, 1, 5.0 + k, 100.0, "N", "O", day) for o in range(1, 9) for k in range(3)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    names += "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(o, o, "O", day, "2-HIGH") for o in range(1, 9)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, names).write.parquet(f"{tmp_path}/orders.parquet")
    people = [(s, f"S{s}", s) for s in range(4)]
    spark.createDataFrame(people, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    events = "event_id long, user_id long, props string, ts timestamp_ntz, event_type string, value double"
    spark.createDataFrame([], events).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert stored_bytes(spark, str(tmp_path), "orders", "none") > 0
    shares = CATALOG["m02_assign_shares"](spark, str(tmp_path))
    assert not [f for f in shares.inputFiles() if "lineitem" in f]
    assert shares.count() >= 24
