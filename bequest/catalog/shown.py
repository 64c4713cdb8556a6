"""Result columns in types that compare across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shown(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text, lists of text joined, structs as JSON."""
    columns = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.concat_ws(",", c)
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)
