"""Tests of a query's plan as SQL that keeps the same rows."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.values import class_of_literal, class_of_type, fitting, is_nan
from ..plans.ast import Leaf, Node

OPERATORS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
Condition = tuple[str, list]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def typed(name: str, t: T.DataType) -> str | None:
    """Whether the database's value is one of the column's type; others are read as null."""
    c = quoted(name)
    if class_of_type(t) == "string":
        return f"typeof({c}) = 'text'"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return f"typeof({c}) in ('integer', 'real')"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"(typeof({c}) = 'integer' or typeof({c}) = 'real' and {c} = cast({c} as integer))"
    return None


def value_of(name: str, t: T.DataType) -> str:
    return f"case when {typed(name, t)} then {quoted(name)} end collate binary"


def text_sql(op: str, name: str, here: str, value: str) -> Condition | None:
    """Texts compare by case, unlike LIKE."""
    c = quoted(name)
    if op == "contains":
        return f"({here} and instr({c}, ?) > 0)", [value]
    if op == "starts_with":
        return f"({here} and substr({c}, 1, length(?)) = ?)", [value, value]
    if op == "ends_with":
        return (f"({here} and substr({c}, -length(?)) = ?)", [value, value]) if value else (here, [])
    return None


def leaf_sql(node: Node, schema: T.StructType) -> Condition | None:
    """A test of a plan as a condition that is true for just the rows that the test keeps, or None."""
    if not isinstance(node, Leaf) or node.ignore_case or node.path not in schema.names:
        return None
    t = schema[node.path].dataType
    here, op, value = typed(node.path, t), node.op, node.value
    if here is None:
        return None
    c = f"{quoted(node.path)} collate binary"
    if op in ("eq", "in", "ne", "not_in"):
        values = value if op in ("in", "not_in") else (value,)
        able = fitting(tuple(values), t)
        if not all(isinstance(v, (int, float, str)) for v in able):
            return None
        parts = [f"{here} and {c} in ({', '.join('?' * len(able))})"] if able else []
        parts += [f"not {here}"] if None in values else []
        found = f"coalesce({' or '.join(f'({p})' for p in parts)}, 0)" if parts else "0"
        return (found if op in ("eq", "in") else f"not {found}"), able
    if op in OPERATORS or op == "between":
        bounds = list(value) if op == "between" else [value]
        if any(class_of_literal(b) != class_of_type(t) or is_nan(b) for b in bounds):
            return "0", []
        if not all(isinstance(b, (int, float, str)) for b in bounds):
            return None
        tests = [f"{c} >= ?", f"{c} <= ?"] if op == "between" else [f"{c} {OPERATORS[op]} ?"]
        return f"({here} and {' and '.join(tests)})", bounds
    if op in ("is_null", "not_null"):
        return (f"not coalesce({here}, 0)" if op == "is_null" else f"coalesce({here}, 0)"), []
    return text_sql(op, node.path, here, value) if class_of_type(t) == "string" and isinstance(value, str) else None
