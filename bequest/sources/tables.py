"""Scans and literal rows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bequest.model import SCHEMAS


_known_schemas: dict[tuple, T.StructType] = {}


def file_status(spark: SparkSession, path: str):
    """What the file system says of a path; raises if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)


def stored_bytes(spark: SparkSession, folder: str, *tables: str) -> int:
    """Size of some tables of a Parquet folder; a table that is not there counts as empty."""
    total = 0
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        total += files.getContentSummary(path).getLength() if files.exists(path) else 0
    return total


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a Parquet table; footers are read once per session and version of the table."""
    key = (spark.sparkContext.applicationId, path, file_status(spark, path).getModificationTime())
    if key not in _known_schemas:
        _known_schemas[key] = spark.read.parquet(path).schema
    return _known_schemas[key]


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a Parquet folder; unused columns and rows are pruned by the optimizer."""
    path = f"{folder}/{table}.parquet"
    return spark.read.schema(schema_of(spark, path)).parquet(path)


def scan_estate(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """An estate table stored in Parquet, read with the declared schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: tuple[int, int],
    partitions: int,
    **options: str,
) -> DataFrame:
    """The same table from a database, read in parallel slices of its numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=key,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        **options,
    )
    return reader.load()


def literal_rows(spark: SparkSession, rows: Iterable[tuple], table_or_schema: str) -> DataFrame:
    """A few rows given in code.

    They become a local relation, whose size the planner knows, so a join broadcasts it
    without moving the other side.
    """
    schema = T.StructType.fromDDL(SCHEMAS.get(table_or_schema, table_or_schema))
    columns = list(zip(*rows)) or [()] * len(schema)
    table = pa.table({f.name: list(values) for f, values in zip(schema, columns)})
    df = spark.createDataFrame(table)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def one_row(spark: SparkSession, **values) -> DataFrame:
    """The one-row source: literals and expressions without a table."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
