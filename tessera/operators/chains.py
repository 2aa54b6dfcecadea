"""Predicates kept for many datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.ast import And, Node, Not, Or, conjuncts
from ..plans.compile import Compiler
from ..plans.normalise import Diagnostics, normalise
from .dataset import Dataset
from .query import Query


@dataclass(frozen=True)
class QueryChain:
    """A predicate, and the schema that it was made for. Equal predicates have equal plan ids."""

    predicate: Node
    schema: T.StructType | None = None

    @classmethod
    def from_(cls, schema: T.StructType | None, build: Callable[[Query], Query]) -> QueryChain:
        chain = cls(build(Query()).where, schema)
        if schema is not None:
            chain.plan(schema)  # unknown paths are errors now, not at the first use
        return chain

    @property
    def plan_id(self) -> str:
        return self.predicate.plan_id

    def plan(self, schema: T.StructType | None = None) -> tuple[Node, Diagnostics]:
        schema = schema or self.schema
        node, diagnostics = normalise(self.predicate, schema)
        Compiler(schema).column(node)
        return node, diagnostics

    def builder(self, source: Dataset | DataFrame) -> Query:
        return Query.over(source).use(self)

    def out(self, source: Dataset | DataFrame):
        return self.builder(source).out()

    def execute(self, source: Dataset | DataFrame) -> list:
        return self.out(source).result()

    def __call__(self, df: DataFrame) -> DataFrame:
        """For ``df.transform(chain)``."""
        return self.out(df).to_df()

    def and_(self, other: QueryChain) -> QueryChain:
        return QueryChain(And((*conjuncts(self.predicate), *conjuncts(other.predicate))), self.schema)

    def or_(self, other: QueryChain) -> QueryChain:
        return QueryChain(Or(self.predicate, other.predicate), self.schema)

    def not_(self) -> QueryChain:
        return QueryChain(Not(self.predicate), self.schema)


def create_chain(build: Callable[[Query], Query], schema: T.StructType | None = None) -> QueryChain:
    return QueryChain.from_(schema, build)


def compile_chain(chain: QueryChain, schema: T.StructType):
    """The chain as a column for a schema."""
    return Compiler(schema).column(chain.predicate)


class ChainRegistry:
    def __init__(self):
        self._chains: dict[str, QueryChain] = {}

    def register(self, name: str, chain: QueryChain) -> QueryChain:
        self._chains[name] = chain
        return chain

    def get(self, name: str) -> QueryChain | None:
        return self._chains.get(name)

    def has(self, name: str) -> bool:
        return name in self._chains

    def remove(self, name: str) -> bool:
        return self._chains.pop(name, None) is not None

    def clear(self) -> None:
        self._chains.clear()

    def names(self) -> list[str]:
        return list(self._chains)
