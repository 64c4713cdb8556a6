"""Streams over several micro-batches against their batch twins."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import NOW, pairs
from pyspark.sql import functions as F

from bequest.functions import dates
from bequest.operators import moves, rules
from bequest.streaming import jobs
from bequest.streaming.state import KeyedState, SlotState, published, publish


class Feed:
    """A folder that receives files; each run of a job reads the new ones, one per batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.files = 0

    def add(self, *data):
        df = self.spark.createDataFrame(list(data), self.schema).coalesce(1)
        df.write.mode("append").parquet(self.folder)

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.folder)


@pytest.fixture
def to(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_gate(spark, estate, tmp_path, to):
    feed = Feed(spark, tmp_path / "in", "seq long, transfer_date timestamp_ntz")
    start = datetime(2025, 6, 9, 8)
    data = [(i, start + timedelta(days=i)) for i in range(40)]
    for low in range(0, 40, 10):
        feed.add(*data[low : low + 10])
    jobs.start_transfer_gate(feed.stream(), estate["holidays"], NOW, *to).awaitTermination()
    accepted = spark.read.parquet(f"{to[0]}/accepted")
    rejected = spark.read.parquet(f"{to[0]}/rejected")
    assert accepted.select("batch").distinct().count() == 4
    batch = spark.createDataFrame(data, feed.schema)
    checked = rules.check_business_day(batch, estate["holidays"], dates.moment(NOW))
    good, bad = rules.split_checked(checked)
    assert pairs(accepted, "seq") == pairs(good, "seq")
    assert pairs(rejected, "seq", "reject_code") == pairs(bad, "seq", "reject_code")


def test_activity_modes(spark, tmp_path, to):
    feed = Feed(spark, tmp_path / "in", "timestamp timestamp_ntz, action string")
    day = datetime(2025, 6, 1, 12)
    feed.add((day, "INSERT"), (day, "INSERT"), (day + timedelta(hours=20), "UPDATE"))
    jobs.start_activity(feed.stream(), *to).awaitTermination()
    feed.add((day + timedelta(days=3), "INSERT"))
    jobs.start_activity(feed.stream(), *to).awaitTermination()
    # Days 1 and 2 are closed by now: a row for day 1 comes too late.
    feed.add((day, "INSERT"))
    feed.add((day + timedelta(days=6), "DELETE"))
    jobs.start_activity(feed.stream(), *to).awaitTermination()
    closed = spark.read.parquet(to[0])
    assert [(str(r.day)[:10], r.action, r["count"]) for r in closed.orderBy("day").collect()] == [
        ("2025-06-01", "INSERT", 2), ("2025-06-02", "UPDATE", 1), ("2025-06-04", "INSERT", 1),
    ]
    full = str(tmp_path / "full"), str(tmp_path / "full-checkpoint")
    jobs.start_activity(feed.stream(), *full, mode="complete").awaitTermination()
    assert published(spark, full[0]).agg(F.sum("count")).first()[0] == 6


def test_status_machine_over_batches(spark, tmp_path, to):
    schema = "seq long, will_id long, new_status string, change_date timestamp_ntz"
    feed = Feed(spark, tmp_path / "in", schema)
    rnd = random.Random(4)
    names = ("Draft", "Approved", "Executing", "Executed")
    day = datetime(2025, 6, 1)
    data = [
        (seq, 1 if rnd.random() < 0.4 else rnd.randrange(2, 12), rnd.choices(names, (5, 4, 6, 0.3))[0], day)
        for seq in range(300)
    ]
    # Two runs: the second continues from the first one's state.
    for low in (0, 60, 120):
        feed.add(*data[low : low + 60])
    jobs.start_status_machine(feed.stream(), "registrar", *to).awaitTermination()
    for low in (180, 240):
        feed.add(*data[low : low + 60])
    jobs.start_status_machine(feed.stream(), "registrar", *to).awaitTermination()
    twin = moves.status_history(spark.createDataFrame(data, schema), "registrar")
    history = spark.read.parquet(f"{to[0]}/history")
    assert history.select("batch").distinct().count() > 1
    columns = ("seq", "will_id", "old_status", "new_status")
    assert pairs(history, *columns) == pairs(twin["history"], *columns)
    rejected = spark.read.parquet(f"{to[0]}/rejected")
    assert pairs(rejected, "seq", "reject_code") == pairs(twin["rejected"], "seq", "reject_code")


def test_share_guard_over_batches(spark, estate, tmp_path, to):
    schema = "seq long, asset_id long, beneficiary_id long, share_percent decimal(7,2)"
    feed = Feed(spark, tmp_path / "in", schema)
    rnd = random.Random(8)
    data = [
        (seq, rnd.choice([12, 12, 71, 81, 31, 99]), rnd.choice([1, 2, 3]), Decimal(rnd.choice(["0.01", "1.50", "4", "9"])))
        for seq in range(90)
    ]
    for low in range(0, 90, 30):
        feed.add(*data[low : low + 30])
    tables = [estate[n] for n in ("assets", "wills", "beneficiaries", "shares")]
    jobs.start_share_guard(feed.stream(), *tables, *to).awaitTermination()
    twin = moves.assign_shares(
        spark.createDataFrame(data, schema), estate, dates.moment(NOW), "registrar"
    )
    accepted = spark.read.parquet(f"{to[0]}/accepted")
    columns = ("asset_id", "beneficiary_id", "share_percent")
    assert pairs(accepted, *columns) == pairs(twin["added"], *columns)
    rejected = spark.read.parquet(f"{to[0]}/rejected")
    assert pairs(rejected, "seq", "reject_code") == pairs(twin["rejected"], "seq", "reject_code")
    total = accepted.groupBy("asset_id").agg(F.sum("share_percent").alias("p"))
    assert {r.asset_id: r.p for r in total.collect()}[12] <= 20


def test_repeats_and_totals(spark, estate, tmp_path, to):
    feed = Feed(spark, tmp_path / "in", "asset_id long, beneficiary_id long, transfer_date timestamp_ntz")
    day = datetime(2025, 6, 9, 8)
    feed.add((22, 3, day), (22, 3, day), (21, 2, day))
    feed.add((22, 3, day + timedelta(hours=1)), (21, 1, day))
    done = estate["transfers"].where("transfer_status = 'Completed'")
    jobs.start_repeat_filter(feed.stream(), done, *to).awaitTermination()
    assert pairs(spark.read.parquet(to[0]), "asset_id", "beneficiary_id") == [(21, 1), (22, 3)]

    rows = str(tmp_path / "rows"), str(tmp_path / "rows-checkpoint")
    keys = str(tmp_path / "keys"), str(tmp_path / "keys-checkpoint")
    for _ in range(2):
        jobs.start_count(feed.stream(), *rows).awaitTermination()
        jobs.start_total(feed.stream(), ["asset_id", "beneficiary_id"], *keys).awaitTermination()
        feed.add((81, 2, day), (22, 3, day))
    jobs.start_count(feed.stream(), *rows).awaitTermination()
    jobs.start_total(feed.stream(), ["asset_id", "beneficiary_id"], *keys).awaitTermination()
    assert published(spark, f"{rows[0]}/total").first().total == 9
    assert published(spark, f"{keys[0]}/total").first().total == 4


def test_repeats_do_not_depend_on_batches_or_dates(spark, estate, tmp_path, to):
    feed = Feed(spark, tmp_path / "in", "asset_id long, beneficiary_id long, transfer_date timestamp_ntz")
    day, rnd = datetime(2025, 6, 9, 8), random.Random(3)
    data = [(rnd.randrange(40), rnd.randrange(3), day - timedelta(days=rnd.randrange(900))) for _ in range(200)]
    for low in range(0, 200, 50):
        feed.add(*data[low : low + 50])
    done = estate["transfers"].where("transfer_status = 'Completed'")
    jobs.start_repeat_filter(feed.stream(), done, *to).awaitTermination()
    completed = set(pairs(done, "asset_id", "beneficiary_id"))
    expected = sorted({r[:2] for r in data} - completed, key=str)
    assert pairs(spark.read.parquet(to[0]), "asset_id", "beneficiary_id") == expected


def test_tables_of_several_files_and_of_one(spark, tmp_path):
    rows = spark.range(90).withColumn("v", F.col("id") * 2)
    tables = tmp_path / "tables"
    rows.repartition(3).write.parquet(str(tables / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tables / "one.parquet")
    for name in ("many", "one"):
        out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint")
        stream = jobs.stream_table(spark, str(tables), name, files_per_trigger=1)
        jobs.start_total(stream, ["id"], out, checkpoint).awaitTermination()
        assert published(spark, f"{out}/total").first().total == 90
    with pytest.raises(Exception, match="none.parquet"):
        jobs.stream_table(spark, str(tables), "none")


def test_a_batch_run_again_finds_its_input(spark, tmp_path):
    state = SlotState(str(tmp_path / "state"), "k long, v long")
    one = lambda v: spark.createDataFrame([(1, v)], "k long, v long")
    assert state.before(spark, 0).count() == 0
    state.after(one(10), 0)
    for _ in range(2):
        seen = state.before(spark, 1).first().v
        state.after(one(seen + 1), 1)
    assert state.before(spark, 2).first().v == 11


def _changes(spark, *data):
    return spark.createDataFrame(list(data), "k long, v long")


def test_keyed_state_of_the_batch_before(spark, tmp_path):
    state = KeyedState(str(tmp_path / "state"), "k long, v long", "k", buckets=4)
    everything = _changes(spark, *((k, 0) for k in range(40)))
    assert state.before(everything, 0).count() == 0
    state.after(everything, 0)
    for _ in range(2):  # the batch runs again
        assert [tuple(r) for r in state.before(_changes(spark, (7, 9), (99, 9)), 1).collect()] == [(7, 0)]
        state.after(_changes(spark, (7, 1)), 1)
    state.after(_changes(spark).limit(0), 2)
    now = state.before(everything, 3)
    assert sorted((r.k, r.v) for r in now.collect()) == [(k, int(k == 7)) for k in range(40)]


def test_keyed_state_does_not_grow_with_batches(spark, tmp_path):
    """Against a dictionary, with one batch in three run twice; parts, lists and files stay few."""
    state, rnd, truth = KeyedState(str(tmp_path / "state"), "k long, v long", "k", buckets=8), random.Random(6), {}
    sizes = []
    for batch_id in range(30):
        changed = {rnd.randrange(60): batch_id for _ in range(rnd.randrange(0, 6))}
        asked = _changes(spark, *((k, 0) for k in [*changed, 3]))
        for _ in range(1 + (batch_id % 3 == 0)):
            before = {r.k: r.v for r in state.before(asked, batch_id).collect()}
            assert before == {k: truth[k] for k in [*changed, 3] if k in truth}
            state.after(_changes(spark, *changed.items()) if changed else asked.limit(0), batch_id)
        truth |= changed
        found = list((tmp_path / "state").glob("part=*/*.parquet"))
        sizes.append(sum(len(spark.read.parquet(str(f)).collect()) for f in found) if batch_id % 10 == 9 else 0)
    assert len(list((tmp_path / "state").glob("list=*"))) == 2
    assert len(list((tmp_path / "state").glob("part=*"))) < 12
    assert max(sizes) < 5 * 60
    everything = state.before(_changes(spark, *((k, 0) for k in range(60))), 30)
    assert {r.k: r.v for r in everything.collect()} == truth


def test_versions_for_readers(spark, tmp_path):
    out = str(tmp_path / "out")
    for version in range(7):
        publish(_changes(spark, (1, version)), out, version, keep=2)
        assert published(spark, out).first().v == version
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["version=5", "version=6"]


def test_completions_while_the_filter_runs(spark, estate, tmp_path, to):
    schema = "asset_id long, beneficiary_id long"
    asked = Feed(spark, tmp_path / "asked", schema)
    done = Feed(spark, tmp_path / "done", schema)
    run = lambda: jobs.start_repeat_filter(asked.stream(), done.stream(), *to).awaitTermination()
    asked.add((1, 1), (1, 1), (2, 1))
    done.add((2, 1), (9, 9))  # completed in the micro-batch in which it is asked for
    run()
    assert pairs(spark.read.parquet(to[0]), "asset_id", "beneficiary_id") == [(1, 1)]
    done.add((3, 1), (1, 1))  # completed between two micro-batches
    run()
    asked.add((3, 1), (4, 1), (1, 1), (9, 9))
    run()
    asked.add((4, 1), (3, 1))
    done.add((4, 1))
    run()
    assert pairs(spark.read.parquet(to[0]), "asset_id", "beneficiary_id") == [(1, 1), (4, 1)]


def test_filter_equals_its_twin_over_batches(spark, tmp_path, to):
    """A request counts if its pair was not asked for before and not completed up to its micro-batch."""
    schema = "asset_id long, beneficiary_id long"
    asked, done = (Feed(spark, tmp_path / name, schema) for name in ("asked", "done"))
    rnd, known, finished, expected = random.Random(8), set(), set(), set()
    for _ in range(4):
        requests = [(rnd.randrange(12), rnd.randrange(2)) for _ in range(12)]
        completions = [(rnd.randrange(12), rnd.randrange(2)) for _ in range(4)]
        asked.add(*requests)
        done.add(*completions)
        finished |= set(completions)
        expected |= set(requests) - known - finished
        known |= set(requests)
        jobs.start_repeat_filter(asked.stream(), done.stream(), *to).awaitTermination()
    assert pairs(spark.read.parquet(to[0]), "asset_id", "beneficiary_id") == sorted(expected, key=str)


def test_provider_of_other_streams_stays(spark, tmp_path, to):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    feed = Feed(spark, tmp_path / "in", "k long")
    feed.add((1,), (1,), (2,))
    jobs.start_total(feed.stream(), ["k"], *to).awaitTermination()
    assert spark.conf.get(provider) == before and before != jobs.ROCKS_DB
    assert published(spark, f"{to[0]}/total").first().total == 2


def test_live_figures_from_changes(spark, tmp_path, to):
    """Counts of keys, of rows that come and go, and an amount, after each batch."""
    assets = Feed(spark, tmp_path / "assets", "asset_id long, value decimal(15,2)")
    wills = Feed(spark, tmp_path / "wills", "will_id long, change long, value decimal(15,2)")
    rnd, known, value, alive, worth = random.Random(3), set(), Decimal(0), 0, Decimal(0)
    for _ in range(4):
        more = [(rnd.randrange(9), Decimal(rnd.randrange(900)) / 100) for _ in range(5)]
        moved = [(rnd.randrange(9), rnd.choice([1, 1, -1, 0]), rnd.choice([None, Decimal("2.50"), Decimal("-1.25")])) for _ in range(4)]
        assets.add(*more)
        wills.add(*moved)
        figures = {
            "assets": jobs.Figure(assets.stream(), ["asset_id"], F.col("value")),
            "wills": jobs.Figure(wills.stream(), None, F.col("value"), F.col("change")),
        }
        jobs.start_live_totals(figures, *to, keep=2).awaitTermination()
        known |= {k for k, _ in more}
        value += sum(v for _, v in more)
        alive += sum(c for _, c, _ in moved)
        worth += sum(v or 0 for *_, v in moved)
        found = {r.name: (r.total, r.amount) for r in published(spark, f"{to[0]}/total").collect()}
        assert found == {"assets": (len(known), value), "wills": (alive, worth)}
    assert len(list((tmp_path / "out" / "total").iterdir())) == 2


def test_machine_that_is_stopped_and_started(spark, tmp_path, to):
    """A batch whose outputs are there but not committed runs again with the same rows."""
    schema = "seq long, will_id long, new_status string, change_date timestamp_ntz"
    feed, day = Feed(spark, tmp_path / "in", schema), datetime(2025, 6, 1)
    rnd = random.Random(14)
    data = [(seq, rnd.randrange(6), rnd.choice(["Draft", "Approved", "Executing"]), day) for seq in range(80)]
    for low in range(0, 80, 20):
        feed.add(*data[low : low + 20])
        jobs.start_status_machine(feed.stream(), "registrar", *to).awaitTermination()
        last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
        for name in (f"{last}", f".{last}.crc"):
            (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    jobs.start_status_machine(feed.stream(), "registrar", *to).awaitTermination()
    twin = moves.status_history(spark.createDataFrame(data, schema), "registrar")
    columns = ("seq", "will_id", "old_status", "new_status")
    assert pairs(spark.read.parquet(f"{to[0]}/history"), *columns) == pairs(twin["history"], *columns)
    rows = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "out" / "state").glob("part=*"))
    assert rows <= 5 * 6
