"""Sinks: accepted rows, JSON results and the CSV export of audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bequest.functions.records import json_text


def append_accepted(checked: DataFrame, folder: str, *partition_by: str) -> None:
    """Append the accepted rows of a checked batch; rejected rows are never written."""
    accepted = checked.where(F.col("reject_code").isNull()).drop("reject_code", "reject_reason")
    accepted.write.mode("append").partitionBy(*partition_by).parquet(folder)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as JSON object text."""
    return df.select(json_text(**{c: F.col(c) for c in df.columns}).alias(name))


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
