"""The audit log laid out by day, and an index of its pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bequest.model import PAGE_SIZE

#: Minutes of a cell of the page index.
CELL = 1


def write_by_day(audit: DataFrame, folder: str) -> None:
    """The log in a partition for each day, newest row first; a busy day has files as its size asks for.

    Rows without a time have a partition of their own.
    """
    stored = audit.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day")
    newest = [F.desc_nulls_first("timestamp"), F.desc("audit_id")]
    stored.sortWithinPartitions("day", *newest).write.mode("overwrite").partitionBy("day").parquet(folder)


def read_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """The log with its day; a filter of the day reads that day's files only."""
    return spark.read.parquet(folder)


def recent_days(by_day: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The partitions that hold the rows since `days` days before a time, without the column of the day.

    The plans of the log filter by time; days only tell which files can have such rows.
    """
    first = F.to_date(as_of - F.make_dt_interval(F.lit(days)))
    return by_day.where(F.col("day") >= first).drop("day")


def one_day(by_day: DataFrame, day: date) -> DataFrame:
    return by_day.where(F.col("day") == F.lit(day)).drop("day")


def _cell() -> Column:
    """The cell of a time within its day; rows without a time are in one of their own."""
    minute = F.hour("timestamp") * 60 + F.minute("timestamp")
    return F.floor(minute / CELL).cast("int")


def write_page_index(by_day: DataFrame, folder: str) -> None:
    """(day, cell, rows, before): how many rows each cell of a day has, and how many rows are newer.

    The log is counted by cell before it is shuffled; a window then adds up the days, of which there are
    few, and one for each day its cells.  Files are in the order of `before`, so a page reads a few rows.
    """
    cells = by_day.groupBy("day", _cell().alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    days = cells.groupBy("day").agg(F.sum("rows").alias("day_rows"))
    earlier = Window.orderBy(F.desc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("newer_days", F.coalesce(F.sum("day_rows").over(earlier), F.lit(0))).drop("day_rows")
    within = Window.partitionBy("day").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("newer", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    joined = cells.join(days.withColumnRenamed("day", "on"), F.col("day").eqNullSafe(F.col("on"))).drop("on")
    index = joined.select("day", "cell", "rows", (F.col("newer_days") + F.col("newer")).alias("before"))
    index.repartitionByRange("before").sortWithinPartitions("before").write.mode("overwrite").parquet(folder)


def indexed_page(
    by_day: DataFrame, index: DataFrame, number: int = 1, per_page: int = PAGE_SIZE
) -> DataFrame:
    """A page of the newest-first log with total and neighbours, as `plans.audit.audit_page` gives it.

    The index tells which cells hold the page; only these are read and sorted, however deep the page lies.
    """
    total = index.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total")).first()["total"]
    skipped = (number - 1) * per_page
    held = (F.col("before") < skipped + per_page) & (F.col("before") + F.col("rows") > skipped)
    cells = index.where(held).collect()  # each has a row of the page at least
    first = min((c["before"] for c in cells), default=0)
    wanted = F.lit(False)
    for c in cells:
        if c["day"] is None:
            wanted = wanted | F.col("day").isNull()
            continue
        start = F.lit(c["day"]).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(c["cell"] * CELL))
        end = start + F.make_dt_interval(mins=F.lit(CELL))
        wanted = wanted | ((F.col("day") == c["day"]) & (F.col("timestamp") >= start) & (F.col("timestamp") < end))
    days = [c["day"] for c in cells if c["day"] is not None]
    span = F.col("day").isNull()
    if days:
        span = F.col("day").between(min(days), max(days)) | (span if len(days) < len(cells) else F.lit(False))
    order = [F.desc_nulls_first("timestamp"), F.desc("audit_id")]
    # Rows of the page's own cells alone.
    rows = by_day.where(span & wanted).drop("day").orderBy(*order).limit(skipped - first + per_page)
    place = F.row_number().over(Window.orderBy(*order)) + F.lit(first)
    return (
        rows.withColumn("rn", place.cast("int"))
        .where(F.col("rn") > skipped)
        .withColumn("total", F.lit(total).cast("long"))
        .withColumn("has_next", F.lit(total > number * per_page))
        .withColumn("has_prev", F.lit(number > 1))
    )
