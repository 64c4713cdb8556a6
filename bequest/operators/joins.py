"""Join helpers: existence tests, grouped totals and joins in which hot keys are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def missing(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def with_flag(df: DataFrame, other: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Mark the rows whose key occurs in `other`; the key set is made distinct first."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(True))
    return attach(df, keys, on).withColumn(flag, F.coalesce(flag, F.lit(False)))


def rows_per(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def attach(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join rows to grouped facts (one row per key) when a key may hold a large part of the rows.

    Grouped facts are already partitioned by their keys, so a plain join would keep them in
    place, and the adaptive skew split, which needs a shuffle on both sides, could not act.
    The second key below is always 0; it makes the planner shuffle both sides for the join, so
    the rows of a hot key are split over many tasks.  Facts small enough are still broadcast.
    """
    lane = F.pmod(F.hash(*keys), F.lit(1))
    left = many.withColumn("__lane", lane)
    right = one.withColumn("__lane", lane)
    return left.join(right, [*keys, "__lane"], how).drop("__lane")


def judged_by_key(batch: DataFrame, keys: list[str], judge, *aggregates: Column) -> DataFrame:
    """Look facts up once per distinct key and hand them to every row of the batch.

    `judge` gets the distinct keys with the given aggregates and adds columns.  However often
    a key repeats in the batch, its lookups run once, on keys alone; the rows themselves are
    shuffled a single time.
    """
    if aggregates:
        distinct = batch.groupBy(*keys).agg(*aggregates)
    else:
        distinct = batch.select(*keys).distinct()
    return attach(batch, judge(distinct), keys)


def first_failure(*checks: tuple[Column, int, Column | str]) -> list[Column]:
    """Code and reason of the first broken rule, NULL for an accepted row."""
    code = F.lit(None).cast("int")
    reason = F.lit(None).cast("string")
    for broken, number, text in reversed(checks):
        text = text if isinstance(text, Column) else F.lit(text)
        code = F.when(broken, F.lit(number)).otherwise(code)
        reason = F.when(broken, text).otherwise(reason)
    return [code.alias("reject_code"), reason.alias("reject_reason")]


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    accepted = checked.where(F.col("reject_code").isNull()).drop("reject_code", "reject_reason")
    return accepted, checked.where(F.col("reject_code").isNotNull())
