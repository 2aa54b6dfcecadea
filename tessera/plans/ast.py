"""Predicates as frozen values. Equal predicates are equal and hash alike, so a plan's identity is its structure."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class Node:
    """A predicate that is true or false for every row."""

    def __and__(self, other: Node) -> Node:
        return And((*parts(self), *parts(other)))

    def __or__(self, other: Node) -> Node:
        return Or(self, other)

    def __invert__(self) -> Node:
        return Not(self)

    @property
    def plan_id(self) -> str:
        return "plan_" + hashlib.sha256(repr(self).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Const(Node):
    value: bool


@dataclass(frozen=True)
class Leaf(Node):
    """One operation on a path. ``value`` is a literal, a tuple of them, or a pattern with its flags."""

    op: str
    path: str
    value: Any = None
    ignore_case: bool = False


@dataclass(frozen=True)
class Exists(Node):
    path: str
    #: Whether null values count, which they do wherever a missing value can't be told from null.
    nullable: bool = True


@dataclass(frozen=True)
class Quantified(Node):
    """some, every or none of a path's values satisfy a function from column to column."""

    kind: str
    path: str
    test: Callable


@dataclass(frozen=True)
class Nested(Node):
    """One element satisfies all of the inner predicate, whose paths start at the element."""

    path: str
    inner: Node


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class Custom(Node):
    """A test of one's own: column expressions by path, or Python on rows as dicts where ``python``."""

    test: Callable
    python: bool = False


TRUE = And(())


def parts(node: Node) -> tuple[Node, ...]:
    return node.children if isinstance(node, And) else (node,)


def conjuncts(node: Node) -> tuple[Node, ...]:
    """The predicate as a flat conjunction."""
    out: list[Node] = []
    for x in parts(node):
        out += conjuncts(x) if isinstance(x, And) else [x]
    return tuple(out)
