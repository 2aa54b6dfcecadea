"""Dot paths into nested rows.

A path yields candidate values: one for a plain path, one for each element where it meets an array. What stands
behind a null parent yields nothing; a second array on a path yields nothing. Paths are resolved against the schema
when a query is compiled, and unknown ones are errors.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import class_of_type, timestamp_of

DEEPEST = 5


class PathError(ValueError):
    """A path that the schema doesn't have, or that can't be used as asked."""


@dataclass(frozen=True)
class Values:
    """The candidates of a path: one column, or an array of them where ``many``."""

    col: Column
    type: T.DataType
    many: bool
    #: True where the path's last parent is there; None stands for always.
    parent: Column | None
    #: Through a second array: no candidates, though the path may exist.
    nothing: bool = False
    #: For existence behind a second array: whether any element is there.
    reached: Column | None = None

    @property
    def kind(self) -> str:
        return class_of_type(self.type)

    def some(self, p: Callable[[Column], Column]) -> Column:
        """Whether any candidate satisfies ``p``; null counts as no only where the caller makes it so."""
        if self.nothing:
            return F.lit(False)
        return F.exists(self.col, lambda x: F.coalesce(p(x), F.lit(False))) if self.many else p(self.col)

    def every(self, p: Callable[[Column], Column]) -> Column:
        """Whether there is a candidate and all satisfy ``p``."""
        if self.nothing:
            return F.lit(False)
        if not self.many:
            return p(self.col) if self.parent is None else p(self.col) & self.parent
        return (F.size(self.col) > 0) & F.forall(self.col, lambda x: F.coalesce(p(x), F.lit(False)))

    def first(self) -> Column:
        if self.nothing:
            return F.lit(None).cast(self.type)
        return F.get(self.col, F.lit(0)) if self.many else self.col

    def listed(self) -> Column:
        """All candidates as an array."""
        if self.nothing:
            return F.array().cast(T.ArrayType(self.type))
        if self.many:
            return F.coalesce(self.col, F.array().cast(T.ArrayType(self.type)))
        one = F.array(self.col)
        return one if self.parent is None else F.when(self.parent, one).otherwise(F.array().cast(T.ArrayType(self.type)))


def step(col: Column | None, t: T.DataType, name: str, path: str) -> tuple[Column, T.DataType]:
    """One segment down from a struct or a map; ``col`` is None at the row itself."""
    if isinstance(t, T.StructType):
        for f in t.fields:
            if f.name == name:
                return (F.col("`" + name.replace("`", "``") + "`") if col is None else col.getField(name)), f.dataType
        raise PathError(f"{path}: there is no {name}; known here: {', '.join(t.names)}")
    if isinstance(t, T.MapType):
        return F.try_element_at(col, F.lit(name)), t.valueType
    if isinstance(t, T.VariantType):
        return F.try_variant_get(col, f'$["{name}"]', "variant"), t
    raise PathError(f"{path}: {name} stands behind a {t.simpleString()}, which has no parts")


def within(element: Column, t: T.DataType, rest: list[str], path: str) -> tuple[Column | None, T.DataType, Column, bool]:
    """Value, type, parent's presence and whether another array came, for the rest of a path behind an array."""
    parent = element
    for k, name in enumerate(rest):
        parent = element
        element, t = step(element, t, name, path)
        if isinstance(t, T.ArrayType):
            leaf = t.elementType
            if k + 1 < len(rest):
                for name_ in rest[k + 1 :]:
                    while isinstance(leaf, T.ArrayType):
                        leaf = leaf.elementType
                    _, leaf = step(F.lit(None), leaf, name_, path)
            return element, leaf, parent.isNotNull(), True
    return element, t, parent.isNotNull(), False


def resolve(schema: T.StructType, path: str, root: Column | None = None) -> Values:
    """The candidates of a path, from a row or from ``root``, a struct of the given schema."""
    parts = path.split(".")
    if not all(parts):
        raise PathError(f"{path!r} is no path")
    if len(parts) > DEEPEST:
        warnings.warn(f"{path}: deeper than {DEEPEST} segments", stacklevel=2)
    # A column whose name has dots is meant where the schema has it so.
    if root is None and len(parts) > 1 and path in schema.names:
        parts = [path]
    col, t, parent = root, schema, root
    for k, name in enumerate(parts):
        parent = col
        col, t = step(col, t, name, path)
        if not isinstance(t, T.ArrayType):
            continue
        there = None if parent is None else parent.isNotNull()
        rest, inner = parts[k + 1 :], t.elementType
        if not rest:
            return Values(col, inner, True, there)
        if isinstance(inner, T.ArrayType):
            raise PathError(f"{path}: arrays of arrays have no parts")
        _, leaf, _, second = within(F.lit(None), inner, rest, path)
        array = col
        reached = F.exists(array, lambda e: F.coalesce(within(e, inner, rest, path)[2], F.lit(False)))
        if second:
            return Values(F.array().cast(T.ArrayType(leaf)), leaf, True, there, nothing=True, reached=reached)
        live = F.filter(array, lambda e: e.isNotNull() & within(e, inner, rest, path)[2])
        return Values(F.transform(live, lambda e: within(e, inner, rest, path)[0]), leaf, True, there, reached=reached)
    return Values(col, t, False, None if parent is None else parent.isNotNull())


def exists(schema: T.StructType, path: str, root: Column | None = None) -> Column:
    """Whether the path is there, whatever its value. Paths that the schema doesn't have are nowhere."""
    try:
        v = resolve(schema, path, root)
    except PathError:
        return F.lit(False)
    if v.reached is not None:
        return F.coalesce(v.reached, F.lit(False))
    if v.kind == "variant":
        return v.col.isNotNull()
    return F.lit(True) if v.parent is None else v.parent


def sort_key(schema: T.StructType, path: str, date: bool = False) -> Column:
    """The first candidate as a sort key; NaN and what is no date count as null."""
    v = resolve(schema, path)
    if date:
        return timestamp_of(v.first(), v.type)
    if v.kind in ("other", "variant", "boolean"):
        raise PathError(f"{path}: a {v.type.simpleString()} has no order")
    key = v.first()
    return F.when(~F.isnan(key), key) if isinstance(v.type, (T.FloatType, T.DoubleType)) else key
