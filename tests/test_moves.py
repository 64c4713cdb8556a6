from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import NOW, codes, pairs
from pyspark.sql import functions as F

from bequest.functions import dates
from bequest.operators import moves
from bequest.operators.ordered import first_rows, last_before

WHO = "registrar"


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def statuses(df) -> dict:
    return {r.will_id: r.status for r in df.collect()}


def test_approve(spark, estate):
    requests = rows(
        spark, "seq long, will_id long", (1, 1), (2, 4), (3, 4), (4, 8), (5, 9), (6, 2)
    )
    out = moves.approve_wills(requests, estate, dates.moment(NOW), WHO)
    after = statuses(out["wills"])
    assert (after[4], after[8], after[1], after[2]) == ("Approved", "Approved", "Draft", "Approved")
    assert pairs(out["history"], "will_id", "old_status", "new_status") == [
        (4, "Draft", "Approved"), (8, "Draft", "Approved"),
    ]
    assert codes(out["rejected"], "seq") == {1: -20095, 3: -20092, 5: -20091, 6: -20092}
    assert out["audit"].count() == requests.count()
    touched = {r.will_id: str(r.last_updated_at) for r in out["wills"].collect()}
    assert touched[4] == NOW and touched[1] == "2025-06-01 00:00:00"


def test_assign_in_order(spark, estate):
    requests = rows(
        spark,
        "seq long, asset_id long, beneficiary_id long, share_percent decimal(7,2)",
        (1, 12, 2, Decimal("15.00")),
        (2, 12, 3, Decimal("10.00")),  # 105: refused, uses nothing up
        (3, 12, 3, Decimal("5.00")),  # exactly 100
        (4, 12, 3, Decimal("0.01")),
        (5, 81, 1, Decimal("10.00")),
        (6, 31, 1, Decimal("1.00")),
        (7, 99, 1, Decimal("1.00")),
    )
    out = moves.assign_shares(requests, estate, dates.moment(NOW), WHO)
    assert pairs(out["added"], "asset_id", "beneficiary_id", "share_percent") == [
        (12, 2, Decimal("15.00")), (12, 3, Decimal("5.00")), (81, 1, Decimal("10.00")),
    ]
    assert codes(out["rejected"], "seq") == {2: -21004, 4: -21004, 6: -21003, 7: -21001}
    assert out["shares"].count() == estate["shares"].count() + 3


def greedy(requests, room):
    left, taken = dict(room), set()
    for asset, seq, cents in sorted(requests, key=lambda r: r[1]):
        if cents <= left.get(asset, 10000):
            left[asset] = left.get(asset, 10000) - cents
            taken.add((asset, seq))
    return taken


@pytest.mark.parametrize("seed,salts", [(1, 1), (2, 3), (3, 16)])
def test_assign_against_a_walk(spark, seed, salts):
    """One asset holds most requests; the walk over all rows is the truth."""
    rnd = random.Random(seed)
    data = []
    for seq in range(4000):
        asset = 1 if rnd.random() < 0.7 else rnd.randrange(2, 60)
        cents = rnd.choice([1, 1, 2, 7, 50, 333, 1000, 2500, 5000, 9999, 10000])
        data.append((asset, seq, cents))
    room = {1: 9000, 2: 0, 3: -500, 4: 10000}
    requests = rows(spark, "asset_id long, seq long, cents long", *data)
    free = rows(spark, "asset_id long, room long", *room.items())
    accepted, refused = moves.accept_in_order(requests, free, salts)
    expected = greedy(data, room)
    assert {(r.asset_id, r.seq) for r in accepted.collect()} == expected
    assert {(r.asset_id, r.seq) for r in refused.collect()} == {
        (a, s) for a, s, _ in data
    } - expected


def test_equal_places_do_not_depend_on_the_layout(spark, estate):
    """Requests with one seq: what they ask for decides, whatever order the rows come in."""
    schema = "seq long, asset_id long, beneficiary_id long, share_percent decimal(7,2)"
    data = [(1, 12, b, Decimal("12.00")) for b in (3, 1, 2)] + [(1, 12, 1, Decimal("12.00"))]
    for order in (data, data[::-1], data[2:] + data[:2]):
        requests = rows(spark, schema, *order).repartition(3)
        out = moves.assign_shares(requests, estate, dates.moment(NOW), WHO)
        assert pairs(out["added"], "beneficiary_id") == [(1,)]
        twice = rows(spark, "seq long, will_id long", (5, 4), (5, 4), (5, 8), (4, 8))
        out = moves.approve_wills(twice.repartition(2), estate, dates.moment(NOW), WHO)
        assert pairs(out["rejected"], "seq", "will_id", "reject_code") == [(5, 4, -20092), (5, 8, -20092)]
        assert out["history"].count() == 2


def test_stored_negative_shares_leave_more_room(spark):
    requests = rows(spark, "asset_id long, seq long, cents long", (1, 1, 10000), (1, 2, 500), (1, 3, 1))
    free = rows(spark, "asset_id long, room long", (1, 10500))
    accepted, refused = moves.accept_in_order(requests, free)
    assert pairs(accepted, "seq") == [(1,), (2,)] and pairs(refused, "seq") == [(3,)]


def test_transfer(spark, estate):
    day = "2025-06-11 09:00:00"
    requests = rows(
        spark,
        "seq long, asset_id long, beneficiary_id long, at string",
        (1, 22, 3, day),
        (2, 22, 3, day),
        (3, 21, 1, day),
        (4, 71, 1, day),  # will 7 has an asset at 95 %
        (5, 22, 3, "2025-06-14 09:00:00"),
        (6, 22, 3, "2025-07-01 09:00:00"),
        (7, 31, 1, "2025-06-14 09:00:00"),  # not transferable and a weekend
        (8, 22, 3, None),
    ).select("seq", "asset_id", "beneficiary_id", F.col("at").cast("timestamp_ntz").alias("transfer_date"))
    out = moves.transfer_assets(requests, estate, dates.moment(NOW), WHO)
    assert codes(out["rejected"], "seq") == {4: -20020, 5: -20001, 6: -20002, 7: -23004}
    assert pairs(out["history"], "will_id", "new_status") == [(2, "Executing")]
    after = statuses(out["wills"])
    assert after[2] == "Executing" and after[7] == "Approved"
    added = out["added"].collect()
    assert len(added) == 4 and {r.transfer_status for r in added} == {"Initiated"}
    assert NOW in {str(r.transfer_date) for r in added}
    assert "Transfer initiated by registrar on 11-JUN-2025 09:00:00" in {r.notes for r in added}
    assert out["audit"].count() == 8


def test_attach(spark, estate):
    requests = rows(
        spark,
        "related_entity string, entity_id long, title string, file_type string",
        (" will ", 1, "My last scan", "PDF"),
        ("ASSET", 99, "Deed", "PDF"),
    )
    out = moves.attach_documents(requests, estate, dates.moment(NOW), WHO)
    kept = out["documents"].collect()[0]
    assert (kept.related_entity, kept.file_path) == ("WILL", "/documents/will_1_My_last_scan.pdf")
    assert [r.reject_code for r in out["rejected"].collect()] == [-24002]
    assert pairs(out["audit"], "action", "status") == [("INSERT", "SUCCESS"), ("PROCEDURE", "ERROR")]


def test_set_primary(spark, estate):
    requests = rows(
        spark, "seq long, executor_id long", (1, 102), (2, 101), (3, 102), (4, None), (5, 999), (6, 109)
    )
    out = moves.set_primary_executors(requests, estate, dates.moment(NOW), WHO)
    after = {r.executor_id: r.is_primary for r in out["executors"].collect()}
    assert (after[101], after[102]) == ("N", "Y")
    assert (after[108], after[109], after[110]) == ("N", "Y", "N")
    assert after[106] is None and after[103] == "Y"
    per_will = out["executors"].where("is_primary = 'Y'").groupBy("will_id").count()
    assert max(r["count"] for r in per_will.collect()) == 1
    assert codes(out["rejected"], "seq") == {4: -25000, 5: -25001}
    told = {(r.action, r.record_id): r.old_values for r in out["audit"].where("status = 'SUCCESS'").collect()}
    assert told[("UPDATE", 102)] == "Previous primary executor: ID 101"
    assert told[("UPDATE", 109)] == "No previous primary executor"
    assert ("DATA_FIX", 8) in told


def test_delete_leaves_no_orphans(spark, estate):
    requests = rows(
        spark,
        "seq long, will_id long, force boolean, confirm_text string",
        (1, 1, False, None),
        (2, 2, True, "DELETE-CONFIRM"),
        (3, 99, False, None),
        (4, 1, False, None),
    )
    kept = moves.delete_wills(requests, estate, dates.moment(NOW), WHO)
    assert sorted(statuses(kept["wills"])) == [2, 3, 4, 5, 6, 7, 8]
    out = moves.delete_wills(requests, estate, dates.moment(NOW), WHO, enforce_protection=False)
    assert sorted(statuses(out["wills"])) == [3, 4, 5, 6, 7, 8]
    assert codes(out["rejected"], "seq") == {3: -26001, 4: -26001}
    assert pairs(out["deleted_counts"], "will_id", "table", "rows") == [
        (1, "assets", 2), (1, "documents", 2), (1, "executors", 2), (1, "history", 1),
        (1, "shares", 3), (1, "wills", 1), (2, "assets", 2), (2, "documents", 1),
        (2, "executors", 1), (2, "history", 1), (2, "shares", 3), (2, "transfers", 2),
        (2, "wills", 1),
    ]
    for child, parent, key in (
        ("assets", "wills", "will_id"), ("executors", "wills", "will_id"),
        ("shares", "assets", "asset_id"), ("transfers", "assets", "asset_id"),
    ):
        assert out[child].join(out[parent], key, "left_anti").count() == 0
    assert out["documents"].count() == 0
    attempts = {r.record_id: r.new_values for r in out["audit"].where("action = 'DELETE_ATTEMPT'").collect()}
    assert attempts[1] == "Related counts - Assets: 2, Executors: 2, Beneficiaries: 3, Documents: 2"


def replay(changes, initial):
    state, history, rejected = dict(initial), [], []
    for seq, will, new in sorted(changes):
        old = state.get(will)
        if old is None or old == new:
            state[will] = new if old is None else old
        elif old == "Executed" or (old == "Draft" and new == "Executing"):
            rejected.append((seq, -20003 if old == "Executed" else -20004))
        else:
            history.append((seq, old, new))
            state[will] = new
    return state, history, rejected


@pytest.mark.parametrize("seed,chunk,known", [(1, 3, False), (2, 50, True), (3, 100_000, True)])
def test_history_against_a_replay(spark, seed, chunk, known):
    rnd = random.Random(seed)
    names = ("Draft", "Approved", "Executing", "Executed")
    data = []
    for seq in range(1500):
        will = 1 if rnd.random() < 0.5 else rnd.randrange(2, 200)
        weights = (6, 4, 8, 0.02 if will == 1 else 1)
        data.append((seq, will, rnd.choices(names, weights)[0]))
    initial = {w: rnd.choice(names[:3]) for w in range(1, 100)} if known else {}
    changes = rows(spark, "seq long, will_id long, new_status string", *data).withColumn(
        "change_date", dates.moment(NOW)
    )
    start = rows(spark, "will_id long, status string", *initial.items()) if known else None
    out = moves.status_history(changes, WHO, start, chunk)
    state, history, rejected = replay(data, initial)
    assert pairs(out["history"], "seq", "old_status", "new_status") == sorted(history, key=str)
    assert pairs(out["rejected"], "seq", "reject_code") == sorted(rejected, key=str)
    seen = {w for _, w, _ in data}
    assert statuses(out["state"]) == {w: s for w, s in state.items() if w in seen}


def test_last_before_and_first_rows(spark):
    rnd = random.Random(5)
    data = [(seq, rnd.choice("ab"), rnd.choice([None, 1, 2, 3])) for seq in range(300)]
    df = rows(spark, "seq long, k string, v int", *data)
    got = {r.seq: r.prev for r in last_before(df, "k", "seq", {"prev": F.col("v")}, 7).collect()}
    last: dict = {}
    for seq, k, v in data:
        assert got[seq] == last.get(k)
        last[k] = v if v is not None else last.get(k)
    for salts in (1, 5, 64):
        picked = first_rows(df, ["k"], ["seq"], F.when(F.col("k") == "a", 4).otherwise(9), salts)
        expected = [s for s, k, _ in data if k == "a"][:4] + [s for s, k, _ in data if k == "b"][:9]
        assert sorted(r.seq for r in picked.collect()) == sorted(expected)


def test_touch_and_diff(spark, estate):
    at = lambda s: F.lit(s).cast("timestamp_ntz").alias("changed_at")
    asset_changes = spark.range(1).select(F.lit(1).alias("will_id"), at("2025-06-05 00:00:00"))
    executor_changes = spark.range(1).select(F.lit(3).alias("will_id"), at("2020-01-01 00:00:00"))
    share_changes = spark.range(1).select(F.lit(21).alias("asset_id"), at("2025-06-07 00:00:00"))
    changes = moves.will_changes(asset_changes, executor_changes, share_changes, estate["assets"])
    after = {r.will_id: str(r.last_updated_at)[:10] for r in moves.touch_wills(estate["wills"], changes).collect()}
    assert (after[1], after[2], after[3]) == ("2025-06-05", "2025-06-07", "2025-06-01")

    new = estate["wills"].where("will_id != 1").withColumn(
        "title", F.when(F.col("will_id") == 2, 'A "new" title').otherwise(F.col("title"))
    )
    told = {r.record_id: r for r in moves.diff_audit(estate["wills"], new, WHO, dates.moment(NOW)).collect()}
    assert set(told) == {1, 2}
    assert told[1].action == "DELETE" and told[1].new_values is None
    assert told[2].new_values == '{"will_id":2,"title":"A \\"new\\" title","status":"Approved"}'
    back = moves.diff_audit(new, estate["wills"], WHO, dates.moment(NOW))
    assert ("INSERT", 1) in pairs(back, "action", "record_id")


def test_executors_and_roles(spark, estate):
    batch = rows(
        spark,
        "seq long, will_id long, full_name string, email string",
        (2, 5, "B", "b@x.rw"), (1, 5, "A", "a@x.rw"), (3, 6, "C", "c@x.rw"),
    )
    added = {r.full_name: r.is_primary for r in moves.add_executors(batch, estate["executors"]).collect()}
    assert added == {"A": "Y", "B": "N", "C": "N"}
    roles = {r.user_id: r.initial_role for r in moves.backfill_roles(estate["users"]).collect()}
    assert roles[2] == "user" and roles[1] == "admin"
    updates = rows(
        spark,
        "seq long, email string, new_role string",
        (1, "ben@home.rw", "testator"), (2, "ben@home.rw", "admin"), (3, None, "admin"),
    )
    roles = {r.user_id: r.initial_role for r in moves.update_roles(estate["users"], updates).collect()}
    assert roles[2] == "admin" and roles[6] is None
