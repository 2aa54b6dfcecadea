"""Python values as the types of a schema, for sources that yield dicts."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import types as T

from ..functions.values import parse_date


def fitted(value: Any, t: T.DataType) -> Any:
    """The value in the type's own Python form, or None where it doesn't fit."""
    if value is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in t.fields) if isinstance(value, dict) else None
    if isinstance(t, T.ArrayType):
        return [fitted(x, t.elementType) for x in value] if isinstance(value, (list, tuple)) else None
    if isinstance(t, T.MapType):
        return {str(k): fitted(x, t.valueType) for k, x in value.items()} if isinstance(value, dict) else None
    if isinstance(t, T.BooleanType):
        return value if isinstance(value, bool) else bool(value) if value in (0, 1) else None
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value // 1 else None
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(t, T.DecimalType):
        return decimal.Decimal(str(value)) if isinstance(value, (int, float)) else None
    if isinstance(t, T.TimestampType):
        return parse_date(value)
    if isinstance(t, T.DateType):
        found = parse_date(value)
        return found.date() if isinstance(found, dt.datetime) else None
    if isinstance(t, T.BinaryType):
        return value if isinstance(value, bytes) else None
    return value if isinstance(value, str) else None


def row_of(value: dict, schema: T.StructType) -> tuple:
    return fitted(value, schema)
