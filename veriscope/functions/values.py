"""Comparison of single result values by their Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriscope import constants as K
from veriscope.functions.text import strip

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATES)


def iso_text(c: Column, dtype: T.DataType) -> Column:
    """ISO text of a date or timestamp; fractions of a second only when present."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    plain = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(exact.endswith(".000000"), plain).otherwise(exact)


def same_value(left: Column, lt: T.DataType, right: Column, rt: T.DataType) -> Column:
    """Null equals null, numbers within a tolerance, texts trimmed, dates as ISO text."""
    both_null = left.isNull() & right.isNull()
    if is_number(lt) and is_number(rt):
        equal = F.abs(left.cast("double") - right.cast("double")) < K.VALUE_EPSILON
    elif isinstance(lt, T.StringType) and isinstance(rt, T.StringType):
        equal = strip(left) == strip(right)
    elif is_date(lt) and isinstance(rt, T.StringType):
        equal = iso_text(left, lt) == strip(right)
    elif isinstance(lt, T.StringType) and is_date(rt):
        equal = strip(left) == iso_text(right, rt)
    elif type(lt) is type(rt):
        equal = left == right
    else:
        equal = F.lit(False)
    return both_null | F.coalesce(equal, F.lit(False))


def type_rank(dtype: T.DataType) -> int:
    """Sort rank of a non-null value's type; null ranks 0."""
    if is_number(dtype):
        return 1
    if isinstance(dtype, T.StringType):
        return 2
    if is_date(dtype):
        return 3
    if isinstance(dtype, T.BinaryType):
        return 4
    return 5


def sort_columns(columns: list[tuple[str, T.DataType]]) -> list[Column]:
    """Order in which unordered results are lined up: nulls first, then the value."""
    return [
        (F.col(n).cast("double") if is_number(t) else F.col(n)).asc_nulls_first()
        for n, t in columns
    ]


def normal_text(c: Column, dtype: T.DataType) -> Column:
    """Hashable form of a value: rounded number, trimmed text, ISO date, hex bytes."""
    if is_number(dtype):
        return F.round(c.cast("double"), 6).cast("string")
    if isinstance(dtype, T.StringType):
        return strip(c)
    if is_date(dtype):
        return iso_text(c, dtype)
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(c))
    return c.cast("string")


def normal_row(columns: list[tuple[str, T.DataType]]) -> Column:
    """Struct of normal forms, each tagged with its type rank so 1 and '1' differ."""
    return F.struct(
        *[
            F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{type_rank(t)}:"), normal_text(F.col(n), t)))
            .alias(f"v{i}")
            for i, (n, t) in enumerate(columns)
        ]
    )
