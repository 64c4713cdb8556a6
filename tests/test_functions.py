from __future__ import annotations

from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bequest import session
from bequest.functions import dates, money, records, text
from bequest.operators import filters, ordered
from bequest.plans import allocations, dashboards, people, transfers, wills
from bequest.sources import tables, writers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    v = lambda c: value(spark, c)
    null = F.lit(None).cast("string")
    assert v(text.join_text(F.lit("a"), null, F.lit(1))) == "a1"
    assert v(text.blank_to_null(F.lit("  "))) is None
    assert v(text.shorten(F.lit("x" * 50))) == "x" * 50
    assert v(text.shorten(F.lit("x" * 51))) == "x" * 50 + "…"
    assert v(text.shorten(null)) == ""
    assert v(text.tail_after(F.lit("a: b: c "), ":")) == "b: c"
    assert v(text.tail_after(F.lit(" none "), ":")) == "none"
    assert v(text.phone_digits(F.lit("+250 788-123-456 99"))) == "250788123456"
    assert v(text.is_phone(F.lit("0788123456"))) is True
    assert v(text.is_phone(F.lit("0718123456"))) is False
    assert v(text.number_in_text(F.lit("RWF 1,234.50"))) == 1234.5
    assert v(text.number_in_text(F.lit("12-3"))) == 12.0
    assert v(text.number_in_text(F.lit("none"))) is None
    assert v(text.title_case(F.lit("no_role here"))) == "No Role Here"


def test_dates(spark):
    v = lambda c: value(spark, c)
    day = lambda s: F.lit(s).cast("date")
    assert [v(dates.day_number(day(f"2025-06-{d}"))) for d in (14, 15, 16)] == [7, 1, 2]
    assert v(dates.full_years(day("2004-02-29"), day("2022-02-28"))) == 17
    assert v(dates.full_years(day("2004-02-29"), day("2022-03-01"))) == 18
    assert v(dates.parse_day(F.lit("2025-13-01"))) is None
    assert v(dates.short_date(F.lit(None).cast("date"))) == "N/A"
    assert v(dates.since(dates.moment("2025-05-12 10:30:00"), dates.moment("2025-06-11 10:30:00"), 30))
    assert not v(dates.since(dates.moment("2025-05-12 10:29:59"), dates.moment("2025-06-11 10:30:00"), 30))


def test_money_and_records(spark):
    v = lambda c: value(spark, c)
    d = lambda s: F.lit(Decimal(s))
    assert [v(money.band(d(p))) for p in ("79.99", "80", "99.99", "100")] == [
        "Incomplete", "Nearly Complete", "Nearly Complete", "Fully Allocated",
    ]
    assert v(money.clamp_percent(d("120.50"))) == 100
    assert v(money.percent_of(d("1"), d("0"))) == 0.0
    assert v(money.rounded_mean(d("1000.50"), F.lit(1))) == 1000.0
    assert v(money.rounded_mean(d("1001.50"), F.lit(1))) == 1002.0
    assert v(money.currency_text(d("1234567"))) == "RWF 1,234,567"
    assert v(records.json_text(a=F.lit('x"y'), b=F.lit(None).cast("string"))) == '{"a":"x\\"y","b":null}'
    assert v(records.display_value(F.lit('{"a": 1}'))) == '{"a":1}'
    assert v(records.display_value(F.lit("{bad"))) == "{bad"
    assert v(records.display_value(F.lit("None"))) == "No data"
    assert v(records.json_field(F.lit("{bad"), "a")) is None


def test_roles_and_visibility(spark, estate):
    e = estate
    args = (e["users"], e["wills"], e["executors"], e["beneficiaries"])
    assert {r.user_id: r.role for r in people.primary_role(*args).collect()} == {
        1: "admin", 2: "testator", 3: "testator", 4: "executor", 5: "executor", 6: "user",
    }
    roles = {r.user_id: r.roles for r in people.all_roles(*args).collect()}
    assert roles[5] == ["executor", "beneficiary"] and roles[6] == ["user"]
    visible = people.will_visibility(*args[:3])
    asked = spark.createDataFrame([(1, 3), (2, 3), (4, 3), (5, 8), (6, 1)], "user_id long, will_id long")
    allowed = {(r.user_id, r.will_id): r.allowed for r in people.may_view(asked, visible).collect()}
    assert allowed == {(1, 3): True, (2, 3): False, (4, 3): True, (5, 8): True, (6, 1): False}


def test_summaries_count_once_or_as_joined(spark, estate):
    e = estate
    exact = {r.will_id: r for r in wills.will_summary_stats(e["assets"], e["shares"], e["executors"]).collect()}
    joined = {
        r.will_id: r
        for r in wills.will_summary_stats(e["assets"], e["shares"], e["executors"], "as_written").collect()
    }
    assert (exact[1].total_assets, exact[1].total_value, exact[1].total_executors) == (2, 1500, 2)
    # Asset 11 has two shares and asset 12 one, each met by two executors.
    assert (joined[1].total_assets, joined[1].total_value, joined[1].total_executors) == (6, 5000, 6)
    assert joined[1].primary_executors == 3
    assert exact[1].total_beneficiaries == joined[1].total_beneficiaries == 2


def test_reports_on_missing_sides(spark, estate):
    e = estate
    worth = {r.will_id: r.total_value for r in wills.will_value(e["wills"], e["assets"]).collect()}
    assert worth[4] is None and worth[1] == 1500
    heirs = {
        r.beneficiary_id: (r.assigned_assets, r.total_inheritance)
        for r in allocations.beneficiary_inheritance(
            e["beneficiaries"], e["shares"], e["assets"]
        ).collect()
    }
    assert heirs[3] == (1, 0)
    assert heirs[1][0] == 5
    report = transfers.transfer_report(e["transfers"], e["assets"], e["beneficiaries"], e["shares"])
    totals = transfers.transfer_totals(report).first()
    assert (totals.total, totals.pending, totals.completed) == (3, 1, 2)
    board = dashboards.executor_dashboard(e["executors"], e["assets"], e["transfers"])
    dan = {r.email: r for r in board.collect()}["dan@law.rw"]
    assert (dan.assigned_wills, dan.pending_transfers, dan.completed_transfers) == (6, 1, 2)


def test_beneficiaries_of_an_asset_have_one_layout(spark):
    assets = spark.createDataFrame([(1, 1, "A", "Other", Decimal("5.00")), (2, 1, "B", "Other", None)],
                                   "asset_id long, will_id long, name string, asset_type string, value decimal(15,2)")
    shares = spark.range(500).select(
        F.lit(1).cast("long").alias("asset_id"), F.col("id").alias("beneficiary_id"),
        F.lit(Decimal("0.20")).alias("share_percent"),
    )
    heirs = spark.range(500).select(
        F.col("id").alias("beneficiary_id"), F.col("id").cast("string").alias("full_name"),
        F.lit("Child").alias("relation"),
    )
    listed = allocations.eligible_beneficiaries(assets, shares, heirs).collect()
    assert sorted(r.beneficiary["id"] for r in listed if r.asset_id == 1) == list(range(500))
    assert [r.beneficiary for r in listed if r.asset_id == 2] == [None]


def test_pages(spark):
    audit = spark.range(230).select(
        F.col("id").alias("audit_id"), (F.col("id") % 7).alias("timestamp")
    )
    order = [F.desc_nulls_first("timestamp"), F.desc("audit_id")]
    expected = sorted(((i % 7, i) for i in range(230)), reverse=True)
    for number in (1, 3, 5):
        got = ordered.page(audit, order, number, 50).orderBy("rn").collect()
        low = (number - 1) * 50
        assert [(r.timestamp, r.audit_id) for r in got] == expected[low : low + 50]
        assert [r.rn for r in got] == list(range(low + 1, low + 1 + len(got)))
    walked, after = [], (F.lit(99), F.lit(0))
    while True:
        rows = ordered.page_after(audit, "timestamp", "audit_id", after, 50).collect()
        if not rows:
            break
        walked += [(r.timestamp, r.audit_id) for r in rows]
        after = (F.lit(rows[-1].timestamp), F.lit(rows[-1].audit_id))
    assert walked == expected


def test_display_order_and_filters(spark, estate):
    shown = spark.createDataFrame([("b",), ("10",), ("9",), ("a",), (None,)], "c string")
    number = text.number_in_text(F.col("c"))
    assert [r.c for r in shown.orderBy(*ordered.display_order(F.col("c"), number)).collect()] == [
        "9", "10", "a", "b", None,
    ]
    assert filters.transfer_tab(estate["transfers"], "pending").count() == 1
    assert filters.transfer_tab(estate["transfers"], "all").count() == 3
    assert filters.search(estate["users"], "ROAD", "address").count() == 3


def test_sources_and_sinks(spark, estate, tmp_path):
    checked = estate["wills"].withColumn(
        "reject_code", F.when(F.col("will_id") == 3, F.lit(-1))
    ).withColumn("reject_reason", F.lit(None).cast("string"))
    folder = str(tmp_path / "wills")
    writers.append_accepted(checked, folder, "status")
    writers.append_accepted(checked, folder, "status")
    back = tables.scan_estate(spark, str(tmp_path), "wills")
    assert back.count() == 14 and back.where("will_id = 3").count() == 0
    writers.write_json(estate["holidays"], str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    odd = spark.createDataFrame([(1, 'say "hi", now'), (2, None)], "k int, t string")
    writers.write_csv(odd, str(tmp_path / "csv"))
    read = spark.read.schema(odd.schema).option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(read.collect()) == sorted(odd.collect())
    assert tables.one_row(spark, a=1, b="x").collect()[0].asDict() == {"a": 1, "b": "x"}
    assert date(2025, 6, 12) in {r.holiday_date for r in estate["holidays"].collect()}


class _Elsewhere:
    """A session's settings on a cluster that names no shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "spark://head:7077"}.get(key, default)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(_Elsewhere())


def test_folders_are_removed(spark):
    folder = session.fresh_folder(spark, "gone")
    spark.range(3).write.parquet(folder)
    session.remove_folders(spark)
    assert not Path(folder).exists()
