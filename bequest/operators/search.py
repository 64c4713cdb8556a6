"""Free-text search over an inverted table of three-letter pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bequest.functions.text import shown_text
from bequest.operators.filters import search

#: Letters of a piece, and the rarest pieces of a term whose lists are met.
PIECE = 3
RAREST = 3


def pieces(text: Column) -> Column:
    """The distinct pieces of a text; none where it is shorter."""
    last = F.length(text) - (PIECE - 1)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(PIECE)))
    return F.when(last >= 1, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def write_search_table(rows: DataFrame, key: str, columns: list[str], folder: str) -> None:
    """(piece, key) of every row's shown text, sorted by piece, and how many rows each piece has.

    Range-partitioned by piece and key, so a piece that many rows have fills several files; a look-up skips
    files and row groups by their smallest and largest piece.
    """
    found = rows.where(F.col(key).isNotNull()).select(
        F.explode(pieces(shown_text(*(F.col(c) for c in columns)))).alias("piece"), F.col(key).alias("key")
    )
    found = found.repartitionByRange("piece", "key").sortWithinPartitions("piece", "key")
    found.write.mode("overwrite").parquet(f"{folder}/lists")
    lists = rows.sparkSession.read.parquet(f"{folder}/lists")
    counted = lists.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    counted.repartitionByRange("piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{folder}/counts")


def search_indexed(rows: DataFrame, key: str, term: str, folder: str, *columns: str) -> DataFrame:
    """`filters.search` by way of the search table: the same rows of those that have a key, which is unique.

    Rows that hold the term hold all its pieces; the lists of its rarest ones are met, and what they have in
    common is compared in full.  A term shorter than a piece is looked for in all rows.
    """
    spark = rows.sparkSession
    keyed = rows.where(F.col(key).isNotNull())
    wanted = spark.range(1).select(pieces(F.lit(term.lower())).alias("pieces")).first()["pieces"]
    if not wanted:
        return search(keyed, term, *columns)
    counts = spark.read.parquet(f"{folder}/counts").where(F.col("piece").isin(wanted))
    known = {r["piece"]: r["rows"] for r in counts.collect()}  # as many as the term has
    if len(known) < len(wanted):
        return keyed.where(F.lit(False))
    rarest = sorted(known, key=lambda p: (known[p], p))[:RAREST]
    lists = spark.read.parquet(f"{folder}/lists").where(F.col("piece").isin(rarest))
    candidates = lists.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") == len(rarest))
    near = keyed.join(candidates.select(F.col("key").alias(key)), key, "left_semi")
    return search(near, term, *columns)
