"""JSON-safe projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import qcol


def _iso_ts(c: Column) -> Column:
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(
        micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def _safe(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return _iso_ts(c)
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, T.DecimalType):
        return c.cast("double")
    if isinstance(dt, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    if type(dt).__name__ in ("DayTimeIntervalType", "YearMonthIntervalType", "TimeType"):
        return c.cast("string")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, dt.elementType))
    return c  # numbers, strings, booleans; structs and maps are not descended


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as doubles, bytes as
    UTF-8 text with replacement, arrays element-wise."""
    return df.select(*[_safe(qcol(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
