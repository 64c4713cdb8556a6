"""Tables laid out for what is asked of them: parts, days, pages, digests, pieces of text."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import pytest
from conftest import NOW, pairs
from pyspark.sql import functions as F

from bequest.functions import dates
from bequest.operators import filters, moves, search, snapshots
from bequest.plans import audit
from bequest.sources import by_day
from bequest.sources.parted import NO_KEY, PartedTable, without
from bequest.sources.tables import literal_rows


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def files_of(folder) -> set[str]:
    return {str(p.relative_to(folder)) for p in folder.glob("version=*/part=*/*.parquet")}


# --- parts -------------------------------------------------------------------------------------


def wills_of(spark, keys, status="Draft"):
    day = datetime(2025, 6, 1)
    return literal_rows(spark, [(k, 2, f"Will {k}", None, status, day, day) for k in keys], "wills")


def test_one_percent_of_wills_rewrites_one_percent_of_files(spark, estate, tmp_path):
    stored = PartedTable(spark, str(tmp_path), "will_id", 10).create(wills_of(spark, range(1000, 2000)))
    before = files_of(tmp_path)
    assert len(before) == 100
    keys = range(1500, 1510)
    executors = literal_rows(spark, [(k, k, "Dan", "dan@law.rw", "Y") for k in keys], "executors")
    tables = estate | {"executors": executors, "assets": estate["assets"].limit(0)}
    requests = spark.createDataFrame([(1, k) for k in keys] + [(2, 1500), (1, 5)], "seq long, will_id long")
    result = moves.approve_in_parts(requests, stored, tables, dates.moment(NOW), "registrar")
    after = files_of(tmp_path)
    assert before < after and {f.split("/")[1] for f in after - before} == {"part=150"}
    twin = moves.approve_wills(requests, tables | {"wills": wills_of(spark, range(1000, 2000))}, dates.moment(NOW), "registrar")
    columns = ("will_id", "status", "last_updated_at")
    assert pairs(result["wills"], *columns) == pairs(twin["wills"], *columns)
    assert pairs(result["rejected"], "will_id", "reject_code") == pairs(twin["rejected"], "will_id", "reject_code")
    # Who reads the version before still can, until it is tidied away.
    assert stored.rows(0).where("status = 'Draft'").count() == 1000
    stored.tidy(keep=1)
    assert len(files_of(tmp_path)) == 100 and stored.rows().count() == 1000
    assert stored.rows(parts={150}).where("status = 'Approved'").count() == 10


def test_changes_that_fail_drop_and_add(spark, tmp_path):
    rows = spark.createDataFrame([(k, k) for k in range(-20, 60)] + [(None, 7)], "k long, v long")
    stored = PartedTable(spark, str(tmp_path), "k", 10).create(rows)
    assert set(stored.parts()) == {*range(-2, 6), NO_KEY}
    keys = lambda *data: spark.createDataFrame([(k,) for k in data], "k long")

    def broken(held):
        held.write.mode("overwrite").parquet(f"{tmp_path}/version=1/part=3")
        raise ValueError("stopped")

    with pytest.raises(ValueError, match="stopped"):
        stored.rewrite(keys(33), broken)
    assert stored.version() == 0 and stored.rows().count() == 81
    assert stored.rewrite(keys(), lambda held: held) == set() and stored.version() == 0
    assert without(stored, keys(*range(30, 40), -5)) == {3, -1}
    assert 3 not in stored.parts()
    added = spark.createDataFrame([(35, 1), (999, 2)], "k long, v long")
    assert stored.rewrite(added.select("k"), lambda held: held.unionByName(added)) == {3, 99}
    assert stored.rewrite(keys(None), lambda held: held.withColumn("v", F.lit(8).cast("long"))) == {NO_KEY}
    truth = {k: k for k in range(-20, 60) if not 30 <= k < 40 and k != -5} | {35: 1, 999: 2, None: 8}
    assert {r.k: r.v for r in stored.rows().collect()} == truth
    stored.tidy(keep=2)
    assert {r.k: r.v for r in PartedTable(spark, str(tmp_path), "k", 10).rows().collect()} == truth


def test_roles_in_parts(spark, estate, tmp_path):
    updates = spark.createDataFrame(
        [(1, "ben@home.rw", "admin"), (2, "ben@home.rw", "executor"), (3, "no@one.rw", "admin"), (4, None, "admin")],
        "seq long, email string, new_role string",
    )
    stored = PartedTable(spark, str(tmp_path), "user_id", 2).create(estate["users"])
    found = moves.update_roles_in_parts(stored, updates)
    assert pairs(found, "user_id", "initial_role") == pairs(moves.update_roles(estate["users"], updates), "user_id", "initial_role")
    assert [part for part, version in stored.parts().items() if version] == [1]


# --- digests -----------------------------------------------------------------------------------


@pytest.mark.parametrize("changed", [0, 1, 40])
def test_snapshots_by_digest(spark, changed):
    rnd = random.Random(changed)
    old = {k: (rnd.choice([None, "a", "b"]), rnd.choice(["Draft", None])) for k in range(500)}
    new = dict(old)
    for k in rnd.sample(range(500), changed):
        kind = rnd.randrange(3)
        if kind == 0:
            del new[k]
        elif kind == 1:
            new[k] = (new[k][1], new[k][0])
        else:
            new[k + 1000] = new[k]
    frames = [
        spark.createDataFrame([(k, *v) for k, v in side.items()], "will_id long, title string, status string")
        for side in (old, new)
    ]
    found = moves.diff_audit_by_digest(*frames, "registrar", dates.moment(NOW), buckets=64)
    whole = moves.diff_audit(*frames, "registrar", dates.moment(NOW))
    columns = ("action", "record_id", "old_values", "new_values")
    assert pairs(found, *columns) == pairs(whole, *columns)
    left, right = snapshots.where_changed(*frames, "will_id", ["title", "status"], 64)
    touched = {k for k in {*old, *new} if old.get(k) != new.get(k)}
    assert left.count() + right.count() <= (len(old) + len(new)) * min(64, len(touched)) / 64 * 2 + 40
    assert (left.count() == 0) == (not touched)


def test_unchanged_rows_are_left_before_the_shuffle(spark, tmp_path):
    for name in ("old", "new"):
        spark.range(2000).selectExpr("id will_id", "'t' title", "'Draft' status").write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / name)) for name in ("old", "new"))
    shown = plan(moves.diff_audit_by_digest(old, new, "registrar", dates.moment(NOW)))
    # Below each sorted or hashed side of the outer join, rows are first compared with the changed buckets.
    assert len(re.findall(r"BroadcastHashJoin LeftSemi", shown)) >= 2


# --- days and pages ----------------------------------------------------------------------------


def log(spark, seed, size=700):
    rnd, day = random.Random(seed), datetime(2024, 1, 1)
    moments = [day + timedelta(days=rnd.choice([0, 0, 0, 1, 2, 5, 9]), minutes=rnd.randrange(90), seconds=rnd.randrange(3)) for _ in range(size // 9)]
    rows = [
        (i, "u", rnd.choice(["INSERT", "UPDATE"]), "WILLS", i, rnd.choice(moments) if rnd.random() < 0.95 else None, "SUCCESS")
        for i in range(size)
    ]
    schema = "audit_id long, user_name string, action string, action_table string, record_id long, timestamp timestamp_ntz, status string"
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture
def stored(spark, tmp_path):
    rows = log(spark, 3).cache()
    by_day.write_by_day(rows, str(tmp_path / "log"))
    held = by_day.read_by_day(spark, str(tmp_path / "log"))
    by_day.write_page_index(held, str(tmp_path / "pages"))
    return rows, held, spark.read.parquet(str(tmp_path / "pages"))


def test_pages_by_index(stored):
    rows, held, index = stored
    for number, size in ((1, 50), (2, 50), (7, 50), (14, 50), (15, 50), (3, 7), (100, 7), (101, 7), (1, 1000)):
        found = by_day.indexed_page(held, index, number, size)
        twin = audit.audit_page(rows, number, size)
        columns = ("rn", "audit_id", "timestamp", "total", "has_next", "has_prev")
        assert pairs(found, *columns) == pairs(twin, *columns)


def test_a_deep_page_reads_its_own_days(stored):
    _, held, index = stored
    cells = index.where("day = date'2024-01-10'").agg(F.min("before"), F.max("before")).first()
    page = by_day.indexed_page(held, index, cells[1] // 10 + 1, 10)
    assert re.search(r"PartitionFilters: \[.*day#", plan(page))
    assert index.count() > 20


def test_recent_days_read_recent_partitions(spark, stored):
    rows, held, _ = stored
    now = dates.moment("2024-01-10 00:30:00")
    pruned = by_day.recent_days(held, now, 5)
    shown = plan(audit.audit_trail(pruned, now, 5))
    assert "PartitionFilters: [isnotnull(day" in shown and "2024-01-05" in shown
    columns = ("user_name", "action", "timestamp", "status")
    assert pairs(audit.audit_trail(pruned, now, 5), *columns) == pairs(audit.audit_trail(rows, now, 5), *columns)
    assert len(pruned.inputFiles()) >= 1
    day = by_day.one_day(held, date(2024, 1, 3))
    assert pairs(filters.facets(day, day=date(2024, 1, 3)), "audit_id") == pairs(filters.facets(rows, day=date(2024, 1, 3)), "audit_id")


def test_days_of_a_table_prune_the_log(spark, stored):
    """A join by day with days that are only known as the query runs."""
    _, held, _ = stored
    days = spark.range(12).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), "id")
    joined = held.join(days.where("id % 5 = 4"), "day")
    assert "dynamicpruning" in plan(joined).lower()


def test_no_rows_no_pages(spark, tmp_path):
    by_day.write_by_day(log(spark, 1).limit(0), str(tmp_path / "log"))
    held = spark.read.schema(log(spark, 1).schema.add("day", "date")).parquet(str(tmp_path / "log"))
    by_day.write_page_index(held, str(tmp_path / "pages"))
    index = spark.read.schema("day date, cell int, rows long, before long").parquet(str(tmp_path / "pages"))
    assert by_day.indexed_page(held, index, 1).count() == 0


# --- search ------------------------------------------------------------------------------------


def test_search_by_pieces_equals_the_scan(spark, tmp_path):
    rnd = random.Random(5)
    words = ["Main", "Street", "KIGALI", "Óscar", "aa", "aaa", "aab", "x.y+z", "50%", "日本語", "ends"]
    text = lambda: None if rnd.random() < 0.1 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(5)))
    rows = spark.createDataFrame([(i, text(), text()) for i in range(300)] + [(None, "Main Street", "x")], "id long, name string, town string").repartition(3)
    search.write_search_table(rows, "id", ["name", "town"], str(tmp_path / "t"))
    keyed = rows.where("id is not null")
    for term in ("street", "MAIN str", "in kig", "aaa", "aab aa", "a", "", "zz", "zzz", "x.y+z", "0%", "ÓSC", "日本語", "ends ", "main street kigali", "aaaa"):
        found = search.search_indexed(rows, "id", term, str(tmp_path / "t"), "name", "town")
        assert pairs(found, "id") == pairs(filters.search(keyed, term, "name", "town"), "id"), term


def test_search_reads_lists_of_its_pieces(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('user', id, ' of ', uuid()) as name")
    search.write_search_table(rows, "id", ["name"], str(tmp_path / "t"))
    found = search.search_indexed(rows, "id", "user499", str(tmp_path / "t"), "name")
    assert re.search(r"PushedFilters: \[.*In\(piece", plan(found))
    assert pairs(found, "id") == [(499,)]
