"""Column-level expression helpers shared by all operators (P3, P4, P6, P7,
P9, epoch seconds). Everything returns built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def qcol(name: str) -> Column:
    """Reference a column by its exact name (P7): dots, spaces and quotes
    are taken literally, never parsed as nested access."""
    return F.col("`" + name.replace("`", "``") + "`")


def strict_double(name: str) -> Column:
    """Cast to DOUBLE that fails on unparsable text under ANSI."""
    return qcol(name).cast("double")


# Numbers as text. Spark's own cast also takes Java's type letters (12d, 3F).
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def try_number(text: Column) -> Column:
    """A double from text, NULL where it is no number."""
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def try_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """Tolerant cast to a naive timestamp; NULL on bad text."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    return try_timestamp_guarded(c.cast("string"))


def epoch_seconds(ts_ntz: Column) -> Column:
    """Fractional seconds since 1970 of a naive timestamp, independent of
    the session time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), ts_ntz)
    return micros.cast("double") / F.lit(1_000_000.0)


def safe_div(num: Column, den: Column) -> Column:
    """NULL when the denominator is 0 (plain division raises under ANSI)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


_ALIAS_RE = re.compile(r"[^A-Za-z0-9_]")


def safe_alias(name: str) -> str:
    """Every character outside [A-Za-z0-9_] becomes '_'."""
    return _ALIAS_RE.sub("_", name)


def safe_aliases(names: list[str]) -> list[str]:
    """P6 for a set of result columns; duplicates get a numeric suffix so
    that e.g. 'a b' and 'a_b' stay distinct."""
    out: list[str] = []
    seen: set[str] = set()
    for n in names:
        base = safe_alias(n)
        cand, i = base, 1
        while cand in seen:
            i += 1
            cand = f"{base}_{i}"
        seen.add(cand)
        out.append(cand)
    return out


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (cross-engine comparisons)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(qcol(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(qcol(f.name))
    return df.select(*cols)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_datetime_type(dt: T.DataType) -> bool:
    names = ("DateType", "TimestampType", "TimestampNTZType", "TimeType",
             "DayTimeIntervalType", "YearMonthIntervalType", "CalendarIntervalType")
    return type(dt).__name__ in names


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Render any value as text; nested values through JSON."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) or \
            type(dtype).__name__ == "VariantType":
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    return c.cast("string")


# ISO date or date-time text: the forms a SQL TIMESTAMP literal takes. Spark's
# own cast also accepts partial forms such as '2024' or '2024-05', which the
# reference engine rejects, so text must match this first.
ISO_TIMESTAMP_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?\s*$"


def try_timestamp_guarded(text: Column) -> Column:
    """P4 on text: naive timestamp, NULL for anything that is not an ISO
    date/date-time or does not name a real instant."""
    return F.when(text.rlike(ISO_TIMESTAMP_TEXT), text.try_cast("timestamp_ntz"))


def fill(template: str, *cols: Column) -> Column:
    """Text template with {0}, {1}, ... filled by column values (concat)."""
    parts, rest = [], template
    for i, c in enumerate(cols):
        head, _, rest = rest.partition("{%d}" % i)
        parts += [F.lit(head), c]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def groupable(dt: T.DataType) -> bool:
    """Whether Spark can group and order values of this type (maps,
    variants and calendar intervals, also nested, cannot)."""
    if isinstance(dt, T.MapType) or type(dt).__name__ in ("VariantType", "CalendarIntervalType"):
        return False
    if isinstance(dt, T.ArrayType):
        return groupable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(groupable(f.dataType) for f in dt.fields)
    return True


def group_key(df: DataFrame, name: str) -> Column:
    """The column for grouping: itself, or its JSON text when its type
    cannot be grouped."""
    c = qcol(name)
    return c if groupable(df.schema[name].dataType) else F.to_json(c)
