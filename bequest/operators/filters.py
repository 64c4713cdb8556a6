"""Optional and free-text filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bequest.functions.text import contains_text


def facets(
    audit: DataFrame,
    action: str | None = None,
    table: str | None = None,
    status: str | None = None,
    day: date | None = None,
    user: str | None = None,
) -> DataFrame:
    """Audit rows by facet; an empty facet keeps everything."""
    for name, wanted in (
        ("action", action),
        ("action_table", table),
        ("status", status),
        ("user_name", user),
    ):
        if wanted:
            audit = audit.where(F.col(name) == wanted)
    if day:
        start = F.lit(day).cast("timestamp_ntz")
        audit = audit.where(
            (F.col("timestamp") >= start)
            & (F.col("timestamp") < start + F.expr("INTERVAL 1 DAY"))
        )
    return audit


def search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows whose shown columns contain the term, whatever the case."""
    shown = columns or tuple(df.columns)
    return df.where(contains_text(term, *[F.col(c) for c in shown]))


def in_tab(tab: str) -> Column:
    """Whether a transfer is listed as pending, as completed, or at all."""
    wanted = {"pending": "Initiated", "completed": "Completed"}.get(tab)
    return F.col("transfer_status") == wanted if wanted else F.lit(True)


def transfer_tab(transfers: DataFrame, tab: str) -> DataFrame:
    """The pending, completed or full list of transfers."""
    return transfers.where(in_tab(tab))
