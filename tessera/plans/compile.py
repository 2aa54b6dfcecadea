"""Predicates to columns.

Every predicate is true or false, never unknown. A positive predicate at the top of a filter may stay unknown, since
a filter drops such rows anyway, and only unwrapped comparisons are pushed down to the scan; under a negation, in an
alternative or inside a lambda it is made false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.paths import PathError, Values, resolve
from ..functions.values import class_of_literal, compare, fitting, java_regex, literal, parse_date, time_test
from .ast import And, Const, Custom, Exists, Leaf, Nested, Node, Not, Or, Quantified

#: Variant values are read as the literal's class.
READ_AS = {"number": ("double", T.DoubleType()), "string": ("string", T.StringType()), "boolean": ("boolean", T.BooleanType()), "date": ("timestamp", T.TimestampType())}
VARIANT_CLASSES = {"number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "date": ("TIMESTAMP", "DATE")}


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Compiler:
    """Compiles for one schema; ``root`` is the struct that paths start from, or None for the row."""

    def __init__(self, schema: T.StructType, root: Column | None = None):
        self.schema, self.root = schema, root

    def column(self, node: Node, strict: bool = True) -> Column:
        """``strict``: the column is never null."""
        if isinstance(node, Const):
            return F.lit(node.value)
        if isinstance(node, Leaf):
            out = self.leaf(node)
            return known(out) if strict else out
        if isinstance(node, Exists):
            return known(paths.exists(self.schema, node.path, self.root))
        if isinstance(node, Quantified):
            return self.quantified(node)
        if isinstance(node, Nested):
            return self.nested(node)
        if isinstance(node, And):
            if not node.children:
                return F.lit(True)
            out = self.column(node.children[0], strict)
            for x in node.children[1:]:
                out = out & self.column(x, strict)
            return out
        if isinstance(node, Or):
            return self.column(node.left) | self.column(node.right)
        if isinstance(node, Not):
            return ~self.column(node.child)
        if isinstance(node, Custom):
            return self.custom(node)
        raise TypeError(f"no predicate: {node!r}")

    def values(self, path: str) -> Values:
        return resolve(self.schema, path, self.root)

    def leaf(self, node: Leaf) -> Column:
        v, op, value = self.values(node.path), node.op, node.value
        if op in ("ne", "not_in"):
            return self.negated(v, op, value)
        if v.kind == "variant" and op not in ("is_null", "not_null"):
            v = self.read_variant(v, op, value)
        return v.some(lambda c: self.test(c, v, node))

    def read_variant(self, v: Values, op: str, value: object) -> Values:
        """A variant as values of the literal's class; values of other classes become null."""
        kind = "string" if op in ("contains", "starts_with", "ends_with", "matches") or op.startswith("date_") else None
        if kind is None:
            literals = value if isinstance(value, tuple) and op in ("in", "between") else (value,)
            kind = next((class_of_literal(x) for x in literals if x is not None), "string")
        name, t = READ_AS[kind]
        named = VARIANT_CLASSES[kind]

        def read(c: Column) -> Column:
            is_class = F.schema_of_variant(c).rlike("^(" + "|".join(named) + ")")
            return F.when(is_class, F.try_variant_get(c, "$", name))

        return Values(F.transform(v.col, read) if v.many else read(v.col), t, v.many, v.parent, v.nothing, v.reached)

    def test(self, c: Column, v: Values, node: Leaf) -> Column:
        op, value, t = node.op, node.value, v.type
        if op == "eq":
            return self.equal(c, v, value)
        if op == "in":
            return self.member(c, v, value)
        if op in ("gt", "gte", "lt", "lte"):
            out = compare(c, t, op, value)
            return F.lit(False) if out is None else out
        if op == "between":
            low, high = compare(c, t, "gte", value[0]), compare(c, t, "lte", value[1])
            return F.lit(False) if low is None or high is None else low & high
        if op in ("contains", "starts_with", "ends_with"):
            if v.kind != "string":
                return F.lit(False)
            c, s = (F.lower(c), value.lower()) if node.ignore_case else (c, value)
            return {"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[op](s)
        if op == "matches":
            return c.rlike(java_regex(*value)) if v.kind == "string" else F.lit(False)
        if op == "is_null":
            gone = F.is_variant_null(c) if v.kind == "variant" else c.isNull()
            return gone if v.parent is None or v.many else gone & v.parent
        if op == "not_null":
            return c.isNotNull() & ~F.is_variant_null(c) if v.kind == "variant" else c.isNotNull()
        if op.startswith("date_"):
            return self.date(c, t, op[5:], value)
        raise ValueError(f"unknown operation {op}")

    def equal(self, c: Column, v: Values, value: object) -> Column:
        kind = class_of_literal(value)
        if kind == "null":
            return c.isNull() if v.parent is None or v.many else c.isNull() & v.parent
        return c == literal(value, v.type) if fitting((value,), v.type) else F.lit(False)

    def member(self, c: Column, v: Values, values: tuple) -> Column:
        able = fitting(values, v.type)
        out = c.isin([literal(x, v.type) if class_of_literal(x) == "date" else x for x in able]) if able else F.lit(False)
        if None in values:
            out = known(out) | self.equal(c, v, None)
        return out

    def negated(self, v: Values, op: str, value: object) -> Column:
        """True for null, missing and empty; single values keep a form that reaches the scan."""
        values = (value,) if op == "ne" else value
        if v.kind == "variant":
            v = self.read_variant(v, "in", tuple(values))
        plain = not v.many and not v.nothing
        able = fitting(tuple(values), v.type)
        if plain and None not in values:
            if not able:
                return F.lit(True)
            if len(able) == 1:
                return ~v.col.eqNullSafe(literal(able[0], v.type))
            return ~v.col.isin([literal(x, v.type) if class_of_literal(x) == "date" else x for x in able]) | v.col.isNull()
        return ~known(v.some(lambda c: self.member(c, v, tuple(values))))

    def date(self, c: Column, t: T.DataType, op: str, value: object) -> Column:
        literals = [parse_date(x) for x in (value if op == "between" else (value,))]
        if any(x is None for x in literals):
            return F.lit(False)
        if op == "between":
            return time_test(c, t, "gte", literals[0]) & time_test(c, t, "lte", literals[1])
        return time_test(c, t, {"equals": "eq", "after": "gt", "after_or_equal": "gte", "before": "lt", "before_or_equal": "lte"}[op], literals[0])

    def quantified(self, node: Quantified) -> Column:
        v = self.values(node.path)
        if node.kind == "every":
            return known(v.every(node.test))
        some = known(v.some(node.test))
        return ~some if node.kind == "none" else some

    def nested(self, node: Nested) -> Column:
        v = self.values(node.path)
        if not isinstance(v.type, T.StructType):
            raise PathError(f"{node.path}: a {v.type.simpleString()} has no parts to look into")
        if has_python(node.inner):
            raise ValueError("Python tests can't look into elements; give a test of columns")
        return known(v.some(lambda e: e.isNotNull() & Compiler(v.type, e).column(node.inner)))

    def custom(self, node: Custom) -> Column:
        if not node.python:
            return known(node.test(lambda path: self.values(path).first()))
        if self.root is not None:
            raise ValueError("Python tests can't look into elements; give a test of columns")
        from .python_test import python_test  # needs pandas, which other queries don't

        return known(python_test(node.test)(F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in self.schema.names])))


def has_python(node: Node) -> bool:
    if isinstance(node, Custom):
        return node.python
    if isinstance(node, And):
        return any(map(has_python, node.children))
    if isinstance(node, Or):
        return has_python(node.left) or has_python(node.right)
    return has_python(node.child) if isinstance(node, Not) else has_python(node.inner) if isinstance(node, Nested) else False


def as_column(node: Node, schema: T.StructType) -> Column:
    """A predicate as a column that is never null."""
    return Compiler(schema).column(node)
