"""What changed between two snapshots of a table, without moving what did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of keys that have a digest each; what is broadcast is at most a number for each of them.
BUCKETS = 1 << 14


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digests(rows: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, one, two): the number of rows and a 128-bit digest for each bucket of keys.

    Taken before the shuffle, so a task hands on a row for each bucket at most.  The order of rows makes no
    difference, and a null is told from any value.
    """
    held = F.array(*(F.col(c).isNull() for c in columns))
    values = [F.col(c) for c in columns]
    return rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64(F.col(key), held, *values)).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(buckets), *values, held, F.col(key))).alias("two"),
    )


def changed_buckets(
    old: DataFrame, new: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS
) -> DataFrame:
    """Buckets of keys in which the snapshots, whose key is unique, are not the same."""
    before, after = (digests(rows, key, columns, buckets) for rows in (old, new))
    digest = ("rows", "one", "two")
    after = after.withColumnsRenamed({c: f"{c}_after" for c in digest})
    same = F.lit(True)
    for c in digest:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_after"))
    return before.join(after, "bucket", "full_outer").where(~same).select("bucket")


def where_changed(
    old: DataFrame, new: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots in buckets that changed: all keys that differ are among them.

    Rows of other buckets go no further than the scan.  That pays where changes are fewer than buckets;
    where they are not, it costs one more scan of the key and the columns.
    """
    changed = F.broadcast(changed_buckets(old, new, key, columns, buckets))

    def chosen(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("bucket", bucket_of(key, buckets))
        return marked.join(changed, "bucket", "left_semi").drop("bucket")

    return chosen(old), chosen(new)
