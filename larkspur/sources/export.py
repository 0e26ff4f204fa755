"""Exports: cleaned frames and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, TimestampNTZType, TimestampType


def cleaned(df: DataFrame) -> DataFrame:
    """Booleans as 0 or 1, timestamps as text, missing numbers as 0 and missing text as empty."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, BooleanType):
            c = F.coalesce(c.cast("int"), F.lit(0))
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        elif isinstance(f.dataType, NumericType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def csv_line(*columns: str) -> Column:
    """One line of comma-separated quoted fields, quotes doubled; nulls empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])
