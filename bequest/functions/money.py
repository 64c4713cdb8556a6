"""Money, percentages and their display."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from bequest.model import FULL_PERCENT, NEAR_PERCENT


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(Decimal("0")))


def share_value(value: Column, percent: Column) -> Column:
    """Exact decimal value of a percentage share."""
    return value * percent * F.lit(Decimal("0.01"))


def remaining(percent: Column) -> Column:
    return F.lit(Decimal(FULL_PERCENT)) - percent


def clamp_percent(percent: Column) -> Column:
    return F.greatest(F.lit(Decimal("0")), F.least(percent, F.lit(Decimal(FULL_PERCENT))))


def band(percent: Column) -> Column:
    return (
        F.when(percent >= FULL_PERCENT, "Fully Allocated")
        .when(percent >= NEAR_PERCENT, "Nearly Complete")
        .otherwise("Incomplete")
    )


def percent_of(part: Column, whole: Column) -> Column:
    """Share of a whole in percent, 0 for an empty whole."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(ratio * 100, F.lit(0.0))


def rounded_mean(total: Column, count: Column) -> Column:
    """Mean rounded half-even to whole units, 0 for no rows."""
    mean = total.cast("double") / F.nullif(count, F.lit(0)).cast("double")
    return F.coalesce(F.bround(mean, 0), F.lit(0.0))


def amount_text(c: Column, decimals: int = 2) -> Column:
    return F.format_number(zero_if_null(c), decimals)


def currency_text(c: Column, currency: str = "RWF", decimals: int = 0) -> Column:
    return F.concat(F.lit(f"{currency} "), amount_text(c, decimals))
