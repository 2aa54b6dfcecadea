"""Queries, what comes after their predicates, search, chains."""

from .chains import ChainRegistry, QueryChain, compile_chain, create_chain
from .dataset import Asked, Dataset
from .egress import Egress, Groups, NoRowError, Paginator
from .query import Query
from .search import Fuzzy, FuzzyField, Rule, Tagger

__all__ = ["Asked", "ChainRegistry", "Dataset", "Egress", "Fuzzy", "FuzzyField", "Groups", "NoRowError", "Paginator", "Query", "QueryChain", "Rule", "Tagger", "compile_chain", "create_chain"]
