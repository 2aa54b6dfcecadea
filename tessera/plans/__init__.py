"""Logical predicates and their compilation to columns."""

from .ast import TRUE, And, Const, Custom, Exists, Leaf, Nested, Node, Not, Or, Quantified, conjuncts
from .compile import Compiler, as_column
from .normalise import Diagnostics, normalise

__all__ = ["TRUE", "And", "Compiler", "Const", "Custom", "Diagnostics", "Exists", "Leaf", "Nested", "Node", "Not", "Or", "Quantified", "as_column", "conjuncts", "normalise"]
