"""Paths into nested rows, and the value semantics that predicates share."""

from .paths import PathError, Values, resolve, sort_key
from .values import compare, class_of_literal, class_of_type, java_regex, parse_date, timestamp_of

__all__ = ["PathError", "Values", "class_of_literal", "class_of_type", "compare", "java_regex", "parse_date", "resolve", "sort_key", "timestamp_of"]
