"""Streaming jobs over append-only sources.

Every job takes a streaming frame and folders in shared storage and gives the started query.
Rules that depend on the order of a key's rows run inside `foreachBatch` with the same
operators as the batch transitions, so a hot key is split within a micro-batch the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bequest.operators import rules
from bequest.operators.joins import matching
from bequest.operators.moves import accept_in_order, numbered, status_history
from bequest.sources.tables import file_status, literal_rows, schema_of
from bequest.streaming.state import KEEP, KeyedState, SlotState, publish, write_batch

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(
    spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A table of a folder as a stream: the files of its directory as they arrive, or its one file.

    Raises if there is neither.
    """
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(schema_of(spark, path))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if file_status(spark, path).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep the keys they know in RocksDB, out of the heap; others are as before."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def start_transfer_gate(
    requests: DataFrame,
    holidays: DataFrame,
    as_of: str,
    out: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Split transfer requests into accepted and rejected ones by the calendar."""
    when = F.lit(as_of).cast("timestamp_ntz")

    def step(batch: DataFrame, batch_id: int) -> None:
        checked = rules.check_business_day(batch, holidays, when).persist()
        accepted, rejected = rules.split_checked(checked)
        write_batch(accepted, f"{out}/accepted", batch_id)
        write_batch(rejected, f"{out}/rejected", batch_id)
        checked.unpersist()

    writer = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def activity_per_day(audit: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Audit rows per day and action; rows later than the delay are dropped."""
    return (
        audit.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day"), "action")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("day"), "action", "count")
    )


def start_activity(
    audit: DataFrame,
    out: str,
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Daily activity as a table: `append` writes closed days, `complete` all of them anew.

    With `complete`, read the newest version with `state.published`.
    """
    counted = activity_per_day(audit)
    if mode == "append":
        writer = counted.writeStream.format("parquet").option("path", out)
    else:

        def step(batch: DataFrame, batch_id: int) -> None:
            publish(batch, out, batch_id)

        writer = counted.writeStream.foreachBatch(step)
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def start_status_machine(
    changes: DataFrame, actor: str, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Status changes to history rows or rejections; one status per will is carried on.

    Within a micro-batch changes are put in seq order; a change that arrives with an older
    batch's seq is judged against the status known by then.
    """
    state = KeyedState(f"{out}/state", "will_id long, status string", "will_id")

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        before = state.before(changed, batch_id)
        result = status_history(changed, actor, before)
        write_batch(result["history"], f"{out}/history", batch_id)
        write_batch(result["rejected"], f"{out}/rejected", batch_id)
        state.after(result["state"], batch_id)
        changed.unpersist()

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def start_share_guard(
    requests: DataFrame,
    assets: DataFrame,
    wills: DataFrame,
    beneficiaries: DataFrame,
    shares: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Accept share requests while their asset stays within 100 %; accepted cents are kept."""
    state = KeyedState(f"{out}/state", "asset_id long, cents long", "asset_id")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        before = state.before(batch, batch_id)
        cents = (F.col("share_percent") * 100).cast("long").alias("cents")
        checked = rules.check_assignment_targets(batch, assets, wills, beneficiaries)
        valid, broken = rules.split_checked(numbered(checked.select("*", cents), "checked-shares"))
        # Stored shares of the batch's assets only.
        stored = matching(shares, batch.select("asset_id").distinct(), "asset_id")
        used = stored.select("asset_id", cents).unionByName(before)
        room = used.groupBy("asset_id").agg((F.lit(10000) - F.sum("cents")).alias("room"))
        accepted, refused = accept_in_order(valid, room)
        over = refused.select(
            *batch.columns,
            F.lit(-21004).alias("reject_code"),
            F.lit("shares would exceed 100 %").alias("reject_reason"),
        )
        write_batch(accepted.select(*batch.columns), f"{out}/accepted", batch_id)
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/accepted/batch={batch_id}")
        write_batch(
            broken.select(*over.columns).unionByName(over), f"{out}/rejected", batch_id
        )
        total = before.unionByName(kept.select("asset_id", cents))
        state.after(total.groupBy("asset_id").agg(F.sum("cents").alias("cents")), batch_id)
        batch.unpersist()

    writer = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


PAIR = ["asset_id", "beneficiary_id"]


def first_requests(requests: DataFrame, completed: DataFrame) -> DataFrame:
    """Streams of requested and of completed (asset, beneficiary) pairs as one row per pair and micro-batch.

    asked_at, done_at: when the pair was first asked for and first completed; latest: this micro-batch.  A
    pair is remembered for good.  Rows of a pair are taken together before they are shuffled, so one that is
    asked for without end costs no more than others.
    """
    asked = requests.select(*PAIR, F.lit(False).alias("done"))
    rows = asked.unionByName(completed.select(*PAIR, F.lit(True).alias("done")))
    # In a stream this is the time of the micro-batch, the same for all its rows and when it runs again.
    return (
        rows.withColumn("at", F.current_timestamp())
        .groupBy(*PAIR)
        .agg(
            F.min(F.when(~F.col("done"), F.col("at"))).alias("asked_at"),
            F.min(F.when(F.col("done"), F.col("at"))).alias("done_at"),
            F.max("at").alias("latest"),
        )
    )


def start_repeat_filter(
    requests: DataFrame,
    completed: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Requested (asset, beneficiary) pairs, each once and none whose transfer is completed.

    `completed` is a table of what is completed at the start, or a stream of completions: a pair counts as
    completed from the micro-batch on in which its completion comes.  How rows of a micro-batch are ordered
    makes no difference.
    """
    if completed.isStreaming:
        seen = first_requests(requests, completed)
    else:
        known = completed.select(*PAIR)
        open_ = requests.select(*PAIR).join(known, PAIR, "left_anti")
        seen = first_requests(open_, open_.where(F.lit(False)))

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where(F.col("done_at").isNull() & (F.col("asked_at") == F.col("latest")))
        write_batch(fresh.select(*PAIR), out, batch_id)

    with _state_on_disk(requests.sparkSession):
        writer = seen.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint)
        return _trigger(writer, every).start()


class Figure(NamedTuple):
    """A live figure: changes of a table as a stream, and what they change.

    A row adds `change` (a number, -1 for a row that goes) to the table's rows and `amount` to its amount.
    With `keys`, rows that repeat a key add nothing to the number of rows; the keys are remembered.
    """

    rows: DataFrame
    keys: list[str] | None = None
    amount: Column | None = None
    change: Column | None = None


LIVE_AMOUNT = "decimal(38,2)"


def live_changes(figures: dict[str, Figure]) -> DataFrame:
    """(name, total, amount): what each row of the streams adds to the figures."""
    none = F.lit(0).cast(LIVE_AMOUNT)
    parts = []
    for name, figure in figures.items():
        amount = none if figure.amount is None else F.coalesce(figure.amount.cast(LIVE_AMOUNT), none)
        change = F.lit(1) if figure.change is None else figure.change
        label = F.lit(name).alias("name")
        one = change.cast("long").alias("total")
        if figure.keys is None:
            parts.append(figure.rows.select(label, one, amount.alias("amount")))
            continue
        parts.append(figure.rows.dropDuplicates(figure.keys).select(label, one, none.alias("amount")))
        if figure.amount is not None:
            parts.append(figure.rows.select(label, F.lit(0).cast("long").alias("total"), amount.alias("amount")))
    return reduce(DataFrame.unionByName, parts)


def start_live_totals(
    figures: dict[str, Figure], out: str, checkpoint: str, every: str | None = None, keep: int = KEEP
) -> StreamingQuery:
    """All figures (name, total, amount), kept up to date by the rows that come; one version after each batch.

    One query reads all streams, so a version's figures belong together.  Only the sums of a batch are added
    to the kept ones.  Read the newest version with `state.published`; the newest `keep` stay.
    """
    spark = next(iter(figures.values())).rows.sparkSession
    state = SlotState(f"{out}/state", f"name string, total long, amount {LIVE_AMOUNT}")
    start = literal_rows(spark, [(name, 0, None) for name in figures], state.schema).fillna(0, ["total"])

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        kept = state.before(session, batch_id) if batch_id else start
        total = kept.unionByName(batch).groupBy("name").agg(
            F.sum("total").alias("total"), F.coalesce(F.sum("amount"), F.lit(0)).cast(LIVE_AMOUNT).alias("amount")
        )
        state.after(total, batch_id)
        publish(state.before(session, batch_id + 1), f"{out}/total", batch_id, keep)

    with _state_on_disk(spark):
        writer = live_changes(figures).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return _trigger(writer, every).start()


def start_total(
    rows: DataFrame, keys: list[str], out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Running number of distinct keys: repeats stay out, new keys add to the kept total.

    Read the newest version with `state.published`.
    """
    return start_live_totals({"total": Figure(rows, keys)}, out, checkpoint, every)


def start_count(
    rows: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Running number of rows of a source whose keys are unique: a plain global aggregate."""

    def step(batch: DataFrame, batch_id: int) -> None:
        publish(batch, f"{out}/total", batch_id)

    writer = (
        rows.agg(F.count(F.lit(1)).alias("total"))
        .writeStream.foreachBatch(step)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, every).start()
