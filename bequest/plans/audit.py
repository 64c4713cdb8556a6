"""Audit pages, trails and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bequest.functions.dates import date_text, day_name, day_number, is_weekend, since
from bequest.model import AUDIT_DAYS, PAGE_SIZE, TEXT_WEEKDAY, TEXT_WEEKEND
from bequest.operators.filters import facets
from bequest.operators.ordered import page



def audit_page(
    audit: DataFrame, number: int = 1, per_page: int = PAGE_SIZE, **wanted
) -> DataFrame:
    """One page of the newest-first audit log with total and neighbours."""
    chosen = facets(audit, **wanted)
    total = chosen.agg(F.count(F.lit(1)).alias("total")).scalar()
    order = [F.desc_nulls_first("timestamp"), F.desc("audit_id")]
    return (
        page(chosen, order, number, per_page)
        .withColumn("total", total)
        .withColumn("has_next", F.col("total") > number * per_page)
        .withColumn("has_prev", F.lit(number > 1))
    )


def audit_trail(audit: DataFrame, as_of: Column, days: int = AUDIT_DAYS) -> DataFrame:
    return (
        audit.where(since(F.col("timestamp"), as_of, days))
        .select("user_name", "action", "action_table", "timestamp", "status")
        .orderBy(F.desc_nulls_first("timestamp"))
    )


def audit_action_counts(audit: DataFrame, as_of: Column, days: int = AUDIT_DAYS) -> DataFrame:
    recent = audit.where(since(F.col("timestamp"), as_of, days))
    return recent.groupBy("action").agg(F.count(F.lit(1)).alias("count"))


def audit_status_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def calendar_status(dates: DataFrame, day: str = "d") -> DataFrame:
    """Whether transfers are open on each date."""
    closed = is_weekend(F.col(day))
    return dates.select(
        F.col(day),
        day_number(F.col(day)).alias("day_number"),
        day_name(F.col(day)).alias("day_name"),
        date_text(F.col(day)).alias("date_text"),
        closed.alias("is_weekend"),
        F.when(closed, TEXT_WEEKEND)
        .otherwise(TEXT_WEEKDAY)
        .alias("status"),
    )
