"""The fluent builder. Each call returns a new query; predicates are joined by and."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame

from ..functions.paths import resolve
from ..functions.values import class_of_literal, parse_date
from ..plans.ast import TRUE, And, Const, Custom, Exists, Leaf, Nested, Node, Not, Or, Quantified, conjuncts
from ..plans.normalise import Diagnostics, normalise
from .dataset import Dataset
from .search import Fuzzy, Search, Tagger, search_of, tags_of


@dataclass(frozen=True)
class Order:
    path: str
    descending: bool = False
    nulls_first: bool = False
    date: bool = False

    @classmethod
    def of(cls, path: str, direction: str = "asc", nulls: str = "last", date: bool = False) -> Order:
        if direction not in ("asc", "desc") or nulls not in ("first", "last"):
            raise ValueError("direction is asc or desc, nulls is first or last")
        return cls(path, direction == "desc", nulls == "first", date)


@dataclass(frozen=True)
class Query:
    """``data`` may be missing in the queries that groups and chains are made of."""

    data: Dataset | None = None
    where: Node = TRUE
    orders: tuple[Order, ...] = ()
    fuzzy: Fuzzy | None = None
    tagger: Tagger | None = None
    searches: tuple[Search, ...] = ()

    @classmethod
    def over(cls, source: Dataset | DataFrame) -> Query:
        return cls(Dataset.of(source))

    def _add(self, node: Node) -> Query:
        return replace(self, where=And((*conjuncts(self.where), node)))

    def _check(self, value: object) -> Any:
        class_of_literal(value)
        return value

    # Scalars.

    def equals(self, path: str, value: Any) -> Query:
        return self._add(Leaf("eq", path, self._check(value)))

    def not_equals(self, path: str, value: Any) -> Query:
        """True for null and for arrays without the value as well."""
        return self._add(Leaf("ne", path, self._check(value)))

    def greater_than(self, path: str, value: Any) -> Query:
        return self._add(Leaf("gt", path, self._check(value)))

    def greater_than_or_equal(self, path: str, value: Any) -> Query:
        return self._add(Leaf("gte", path, self._check(value)))

    def less_than(self, path: str, value: Any) -> Query:
        return self._add(Leaf("lt", path, self._check(value)))

    def less_than_or_equal(self, path: str, value: Any) -> Query:
        return self._add(Leaf("lte", path, self._check(value)))

    def between(self, path: str, low: Any, high: Any) -> Query:
        return self._add(Leaf("between", path, (self._check(low), self._check(high))))

    def in_(self, path: str, values: Iterable) -> Query:
        values = tuple(map(self._check, values))
        return self._add(Leaf("in", path, values) if values else Const(False))

    def not_in(self, path: str, values: Iterable) -> Query:
        values = tuple(map(self._check, values))
        return self._add(Leaf("not_in", path, values) if values else Const(True))

    # Texts.

    def contains(self, path: str, text: str, ignore_case: bool = False) -> Query:
        return self._add(Leaf("contains", path, text, ignore_case))

    def starts_with(self, path: str, text: str, ignore_case: bool = False) -> Query:
        return self._add(Leaf("starts_with", path, text, ignore_case))

    def ends_with(self, path: str, text: str, ignore_case: bool = False) -> Query:
        return self._add(Leaf("ends_with", path, text, ignore_case))

    def matches(self, path: str, pattern: str | re.Pattern, flags: str = "") -> Query:
        """Whether the pattern is found anywhere."""
        return self._add(Leaf("matches", path, (pattern, flags)))

    # Null and existence.

    def is_null(self, path: str) -> Query:
        return self._add(Leaf("is_null", path))

    def value_not_null(self, path: str) -> Query:
        return self._add(Leaf("not_null", path))

    def path_exists(self, path: str) -> Query:
        return self._add(Exists(path))

    def path_exists_nullable(self, path: str) -> Query:
        """As ``path_exists``: stored data has no values that are there and undefined."""
        return self._add(Exists(path, True))

    # Dates.

    def _date(self, op: str, path: str, *values: Any) -> Query:
        times = tuple(map(parse_date, values))
        return self._add(Const(False) if None in times else Leaf(f"date_{op}", path, times if len(times) > 1 else times[0]))

    def date_equals(self, path: str, value: Any) -> Query:
        return self._date("equals", path, value)

    def date_after(self, path: str, value: Any) -> Query:
        return self._date("after", path, value)

    def date_after_or_equal(self, path: str, value: Any) -> Query:
        return self._date("after_or_equal", path, value)

    def date_before(self, path: str, value: Any) -> Query:
        return self._date("before", path, value)

    def date_before_or_equal(self, path: str, value: Any) -> Query:
        return self._date("before_or_equal", path, value)

    def date_between(self, path: str, low: dt.datetime | str | float, high: dt.datetime | str | float) -> Query:
        return self._date("between", path, low, high)

    # Arrays, elements, groups.

    def array_some(self, path: str, test: Callable[[Column], Column]) -> Query:
        return self._add(Quantified("some", path, test))

    def array_every(self, path: str, test: Callable[[Column], Column]) -> Query:
        """False where there are no values."""
        return self._add(Quantified("every", path, test))

    def array_none(self, path: str, test: Callable[[Column], Column]) -> Query:
        return self._add(Quantified("none", path, test))

    def nested(self, path: str, build: Callable[[Query], Query]) -> Query:
        """One element satisfies all that ``build`` adds; its paths start at the element."""
        return self._add(Nested(path, build(Query()).where))

    def and_(self, build: Callable[[Query], Query]) -> Query:
        return self._add(And(conjuncts(build(Query()).where)))

    def or_(self, build: Callable[[Query], Query]) -> Query:
        """All so far, or the group. An empty group changes nothing; after nothing, the group stands alone."""
        group = build(Query()).where
        if not conjuncts(group):
            return self
        return replace(self, where=And((Or(self.where, group),)) if conjuncts(self.where) else group)

    def not_(self, build: Callable[[Query], Query]) -> Query:
        """Not all of the group; nothing matches the opposite of an empty group."""
        return self._add(Not(build(Query()).where))

    def custom(self, test: Callable, python: bool = False) -> Query:
        """``test`` gets a function from path to column and returns a column; with ``python``, rows as dicts."""
        return self._add(Custom(test, python))

    def use(self, chain) -> Query:
        """All of a chain's predicate."""
        return self._add(chain.predicate)

    # Search.

    def configure_fuzzy(self, fields: Iterable, **options) -> Query:
        return replace(self, fuzzy=Fuzzy.of(fields, **options))

    def configure_tagger(self, tags: Iterable[str], rules: Iterable, **options) -> Query:
        return replace(self, tagger=Tagger.of(tags, rules, **options))

    def search(self, what: str | list | dict) -> Query:
        return replace(self, searches=(*self.searches, search_of(what, self.fuzzy, self.tagger)))

    def tags(self, has: Iterable[str] = (), has_any: Iterable[str] = (), not_: Iterable[str] = (), not_any: Iterable[str] = ()) -> Query:
        return replace(self, searches=(*self.searches, tags_of(self.tagger, has, has_any, not_, not_any)))

    # Orders, which hold for what comes out.

    def order_by(self, path: str, direction: str = "asc", nulls: str = "last") -> Query:
        return replace(self, orders=(*self.orders, Order.of(path, direction, nulls)))

    def order_by_date(self, path: str, direction: str = "asc", nulls: str = "last") -> Query:
        return replace(self, orders=(*self.orders, Order.of(path, direction, nulls, date=True)))

    then_by, then_by_date = order_by, order_by_date

    # Results.

    def on(self, source: Dataset | DataFrame) -> Query:
        return replace(self, data=Dataset.of(source))

    def out(self):
        from .egress import Egress

        if self.data is None:
            raise ValueError("a group has no rows of its own")
        return Egress(self)

    def plan(self) -> tuple[Node, Diagnostics]:
        if self.data is None:
            raise ValueError("a plan needs a schema")
        for x in self.orders:
            resolve(self.data.schema, x.path)
        return normalise(self.where, self.data.schema)

    @property
    def plan_id(self) -> str:
        return self.where.plan_id
