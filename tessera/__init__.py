"""A nested-data query engine that compiles to plain DataFrame expressions."""

from .functions import PathError
from .operators import Asked, ChainRegistry, Dataset, Egress, Fuzzy, FuzzyField, Groups, NoRowError, Paginator, Query, QueryChain, Rule, Tagger, compile_chain, create_chain
from .plans import telemetry

__all__ = ["Asked", "ChainRegistry", "Dataset", "Egress", "Fuzzy", "FuzzyField", "Groups", "NoRowError", "Paginator", "PathError", "Query", "QueryChain", "Rule", "Tagger", "compile_chain", "create_chain", "telemetry"]
