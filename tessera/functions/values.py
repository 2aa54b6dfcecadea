"""Value classes, dates and regular expressions.

Values of different classes are never equal and never compare; nothing is coerced. NaN equals nothing and compares
with nothing. Dates are timestamps, ISO strings of a fixed form, or numbers of milliseconds since 1970 (UTC).
"""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC = dt.timezone.utc
#: The only strings that count as dates (a fixed form).
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def class_of_type(t: T.DataType) -> str:
    if isinstance(t, NUMBERS):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "variant" if isinstance(t, T.VariantType) else "other"


def class_of_literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, Decimal)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (dt.datetime, dt.date)):
        return "date"
    raise TypeError(f"values of {type(v).__name__} can't be compared: use a number, text, truth value, date or None")


def is_nan(v: object) -> bool:
    return isinstance(v, float) and math.isnan(v)


def instant(v: dt.datetime | dt.date) -> dt.datetime:
    """Naive dates and times are UTC."""
    if not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    return v.replace(tzinfo=UTC) if v.tzinfo is None else v.astimezone(UTC)


def parse_date(v: object) -> dt.datetime | None:
    """A literal as a time, or None. A day beyond its month's end runs over into the next month."""
    if isinstance(v, (dt.datetime, dt.date)):
        return instant(v)
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float, Decimal)):
        try:
            return dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(milliseconds=int(v))
        except (ValueError, OverflowError):
            return None
    if isinstance(v, str) and re.match(ISO_DATE, v, re.A) and not v.endswith("\n"):
        year, month, day = int(v[:4]), int(v[5:7]), int(v[8:10])
        try:
            if not 1 <= day <= 31:
                return None
            start = dt.datetime(year, month, 1, tzinfo=UTC) + dt.timedelta(days=day - 1)
            if len(v) == 10:
                return start
            rest = re.sub(r"\.(\d{1,6})\d*", lambda m: "." + m[1].ljust(6, "0"), v[11:]).replace("Z", "+00:00")
            clock = dt.time.fromisoformat(rest)
            zone = clock.tzinfo.utcoffset(None) if clock.tzinfo else dt.timedelta(0)
            return dt.datetime.combine(start.date(), clock.replace(tzinfo=UTC)) - zone
        except (ValueError, OverflowError):
            return None
    return None


def timestamp_of(c: Column, t: T.DataType) -> Column:
    """A column's values as times; null where they are none. What names no zone is UTC, whatever the session's zone."""
    kind = class_of_type(t)
    if isinstance(t, T.DateType):
        return F.timestamp_seconds(F.unix_date(c) * F.lit(86400).cast("long"))
    if isinstance(t, T.TimestampNTZType):
        return F.concat(c.cast("string"), F.lit("Z")).cast("timestamp")
    if kind == "date":
        return c
    if kind == "number":
        ms = c.cast("double")
        return F.when(~F.isnan(ms) & (F.abs(ms) <= 8.64e15), F.timestamp_millis(ms.cast("long")))
    if kind == "string":
        zone = F.when(F.length(c) == 10, "T00:00:00Z").when(c.rlike(r"(Z|[+-]\d{2}:\d{2})\z") & (F.length(c) > 10), "").otherwise("Z")
        return F.when(c.rlike(ISO_DATE.replace("$", r"\z")), F.concat(c, zone).try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def time_test(c: Column, t: T.DataType, op: str, v: dt.datetime) -> Column:
    """``c op v``. Dates are compared with a date, so that this reaches the scan: a day begins at midnight, UTC."""
    if isinstance(t, T.DateType):
        midnight = v == v.replace(hour=0, minute=0, second=0, microsecond=0)
        right = F.lit(v.date())
        if op == "eq" and not midnight:
            return F.lit(False)
        op = op if midnight else {"gte": "gt", "lt": "lte"}.get(op, op)
    else:
        c, right = comparable_time(c, t), time_literal(v, t)
    return {"eq": c == right, "gt": c > right, "gte": c >= right, "lt": c < right, "lte": c <= right}[op]


def time_literal(v: dt.datetime, t: T.DataType) -> Column:
    """In the column's own type, so that the comparison reaches the scan."""
    if isinstance(t, T.TimestampNTZType):
        return F.lit(v.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v.isoformat(sep=" ")).cast("timestamp")


def comparable_time(c: Column, t: T.DataType) -> Column:
    return c if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else timestamp_of(c, t)


def literal(v: object, t: T.DataType) -> Column:
    if class_of_literal(v) == "date":
        return F.lit(instant(v).date()) if isinstance(t, T.DateType) else time_literal(instant(v), t)
    return F.lit(v)


def fitting(values: tuple, t: T.DataType) -> list:
    """The literals that a value of the type can equal: those of its class but for NaN and, among days, what isn't midnight (UTC)."""
    kind, out = class_of_type(t), [v for v in values if v is not None and not is_nan(v) and class_of_literal(v) == class_of_type(t)]
    if kind == "date" and isinstance(t, T.DateType):
        return [v for v in out if instant(v).time() == dt.time(0)]
    return out


def compare(c: Column, t: T.DataType, op: str, v: object) -> Column | None:
    """``c op v`` for values of one class; None where the classes differ or nothing can match."""
    kind = class_of_literal(v)
    if kind in ("null", "boolean") or is_nan(v) or class_of_type(t) != kind:
        return None
    if kind == "date":
        return time_test(c, t, op, instant(v))
    right = literal(v, t)
    out = {"gt": c > right, "gte": c >= right, "lt": c < right, "lte": c <= right}[op]
    # NaN is greater than everything in Spark.
    return out & ~F.isnan(c) if op in ("gt", "gte") and isinstance(t, (T.FloatType, T.DoubleType)) else out


def java_regex(pattern: str | re.Pattern, flags: str = "") -> str:
    """A pattern in the usual script dialect as Java reads it. g and y don't matter for a test."""
    if isinstance(pattern, re.Pattern):
        flags += "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
        pattern = pattern.pattern
    if bad := set(flags) - set("gimsuy"):
        raise ValueError(f"unknown flags: {''.join(sorted(bad))}")
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            n = pattern[at + 1]
            if n in "sS":
                blank = r"\s\x{a0}\x{feff}\x{2028}\x{2029}\p{Zs}"
                if inside and n == "S":
                    raise ValueError(r"\S within brackets isn't supported")
                out.append(blank if inside else f"[{'^' if n == 'S' else ''}{blank}]")
            elif n == "u" and pattern[at + 2 : at + 3] == "{":
                raise ValueError("code point escapes in braces aren't supported")
            else:
                out.append(c + n)
            at += 2
            continue
        if inside:
            # Java gives a meaning to these within brackets.
            out.append("\\" + c if c in "[&" else c)
            inside = c != "]"
        elif c == "[":
            if pattern.startswith("[^]", at) or pattern.startswith("[]", at):
                raise ValueError("brackets must hold something")
            out.append(c)
            inside = True
            if pattern[at + 1 : at + 2] == "^":
                out.append("^")
                at += 1
        else:
            out.append(r"\z" if c == "$" and "m" not in flags else c)
        at += 1
    on = "".join(f for f in "ims" if f in flags)
    return f"(?{on})" + "".join(out) if on else "".join(out)
