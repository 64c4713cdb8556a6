"""Order-dependent operators that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000
SALTS = 256


def last_before(
    df: DataFrame, key: str, seq: str, picks: dict[str, Column], chunk: int = CHUNK
) -> DataFrame:
    """For each row, the last non-NULL pick among earlier rows of its key.

    `seq` numbers the rows of the whole table uniquely.  Rows are cut into runs of `chunk`
    numbers: a task sorts at most `chunk` rows of one key, and across runs only one summary
    row per run and key is carried on.
    """
    base = df.withColumn("__chunk", F.floor(F.col(seq) / chunk))
    for name, pick in picks.items():
        base = base.withColumn(f"__{name}", pick)

    ends = base.groupBy(key, "__chunk").agg(
        *[
            F.max_by(f"__{name}", F.when(F.col(f"__{name}").isNotNull(), F.col(seq))).alias(
                f"__{name}"
            )
            for name in picks
        ]
    )
    runs = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        key,
        "__chunk",
        *[F.last(f"__{name}", True).over(runs).alias(f"__in_{name}") for name in picks],
    )
    inside = (
        Window.partitionBy(key, "__chunk")
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    near = base.select(
        *df.columns,
        "__chunk",
        *[F.last(f"__{name}", True).over(inside).alias(f"__at_{name}") for name in picks],
    )
    return near.join(carried, [key, "__chunk"], "left").select(
        *df.columns,
        *[F.coalesce(f"__at_{name}", f"__in_{name}").alias(name) for name in picks],
    )


def first_rows(
    df: DataFrame, group: list[str], order: list[str], limit: Column, salts: int = SALTS
) -> DataFrame:
    """The first `limit` rows of every group (`limit` constant within a group).

    A first pass keeps the first rows of each salted piece of a group, so that no task ever
    holds a whole hot group; the second pass picks from the survivors.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    pieces = df.withColumn("__salt", salt)
    for parts in (group + ["__salt"], group):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        pieces = pieces.withColumn("__place", place).where(F.col("__place") <= limit)
    return pieces.drop("__salt", "__place")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with their overall position.

    What is sorted grows with the page number; deep pages are better reached by `page_after`.
    """
    offset = (number - 1) * size
    rows = df.orderBy(*order).offset(offset).limit(size)
    place = F.row_number().over(Window.orderBy(*order)) + offset
    return rows.withColumn("rn", place)


def page_after(
    df: DataFrame, newest: str, tie: str, after: tuple[Column, Column], size: int
) -> DataFrame:
    """The page following a known last row, newest first; cost does not grow with depth."""
    when, key = after
    older = (F.col(newest) < when) | ((F.col(newest) == when) & (F.col(tie) < key))
    return df.where(older).orderBy(F.desc(newest), F.desc(tie)).limit(size)


def display_order(c: Column, number: Column) -> list[Column]:
    """Sort by a shown column: numbers by value first, then text."""
    return [number.isNull().asc(), number.asc_nulls_last(), c.asc_nulls_last()]
