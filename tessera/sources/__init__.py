"""Where rows come from: files, SQL tables, HTTP, key-value stores. Each gives a plain DataFrame."""

from .files import json_array, ndjson, parquet
from .http import HttpPages, http_rows
from .openapi import openapi_request, openapi_schema
from .redis import redis_rows, redis_sorted_rows
from .sqlite import sqlite_query, sqlite_table

__all__ = ["HttpPages", "http_rows", "json_array", "ndjson", "openapi_request", "openapi_schema", "parquet", "redis_rows", "redis_sorted_rows", "sqlite_query", "sqlite_table"]
