"""SQLite tables and queries. Of a query over a table, tests reach the database, and orders do with a limit."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dataset import Asked, from_source
from .files import as_struct
from .filters import leaf_sql, quoted, typed, value_of
from .rows import fitted


def connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    """Row ids from ``low`` to below ``high``; None stands for the whole."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__(None)
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Filters come as an option and not through Spark: it would keep those of one query for later ones on the same DataFrame."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "1"))
        if n < 2 or "table" not in self.options:
            return [Range(None, None)]
        with connected(self.options["path"]) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.options['table'])}").fetchone()
        if low is None:
            return [Range(None, None)]
        size = -(-(high - low + 1) // n)
        return [Range(a, min(a + size, high + 1)) for a in range(low, high + 1, size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if "query" in self.options:
            sql, values = self.options["query"], json.loads(self.options.get("parameters", "[]"))
        else:
            conditions = json.loads(self.options.get("conditions", "[]"))
            if partition.low is not None:
                conditions.append(("rowid >= ? and rowid < ?", [partition.low, partition.high]))
            sql = f"select {', '.join(quoted(f.name) for f in self.schema.fields)} from {quoted(self.options['table'])}"
            sql += " where " + " and ".join(c for c, _ in conditions) if conditions else ""
            values = [v for _, vs in conditions for v in vs]
        db = connected(self.options["path"])
        try:
            for row in db.execute(sql, values):
                yield tuple(fitted(v, f.dataType) for v, f in zip(row, self.schema.fields, strict=True))
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def _read(spark: SparkSession, schema: T.StructType, **options: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).schema(schema).options(**options).load()


class SqliteTable:
    """A table as a source that answers for tests, orders and limits itself, where SQL means the same."""

    def __init__(self, spark: SparkSession, path: str, table: str, schema: T.StructType | str, partitions: int = 1):
        self.spark, self.path, self.table, self.schema, self.partitions = spark, path, table, as_struct(schema), partitions

    def materialize(self, conditions: Iterable = ()) -> DataFrame:
        return _read(self.spark, self.schema, path=self.path, table=self.table, partitions=str(self.partitions), conditions=json.dumps(list(conditions)))

    def statement(self, asked: Asked) -> tuple[str, list] | None:
        """The query for the rows that come first, or None where a test or an order can't be told in SQL."""
        conditions = [leaf_sql(x, self.schema) for x in asked.where]
        keys = [(o.path, o.descending, o.nulls_first) for o in asked.orders] + [(k, False, True) for k in asked.unique_key]
        plain = all(not o.date for o in asked.orders) and all(k in self.schema.names and typed(k, self.schema[k].dataType) for k, _, _ in keys)
        if asked.limit is None or None in conditions or not plain:
            return None
        sql = f"select {', '.join(quoted(n) for n in self.schema.names)} from {quoted(self.table)}"
        sql += " where " + " and ".join(c for c, _ in conditions) if conditions else ""
        orders = [f"{value_of(k, self.schema[k].dataType)} {'desc' if down else 'asc'} nulls {'first' if first else 'last'}" for k, down, first in keys]
        return f"{sql} order by {', '.join([*orders, 'rowid'])} limit ?", [v for _, vs in conditions for v in vs] + [asked.limit]

    def pushdown(self, asked: Asked) -> DataFrame:
        if made := self.statement(asked):
            return sqlite_query(self.spark, self.path, made[0], self.schema, made[1])
        return self.materialize(c for x in asked.where if (c := leaf_sql(x, self.schema)))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: T.StructType | str, partitions: int = 1) -> DataFrame:
    """The columns of ``schema`` of a table, read in so many ranges of row ids. Queries over it are answered by the database as far as it can."""
    return from_source(SqliteTable(spark, path, table, schema, partitions))


def sqlite_query(spark: SparkSession, path: str, query: str, schema: T.StructType | str, parameters: Iterable = ()) -> DataFrame:
    """The rows of a query with positional parameters; its columns stand in the schema's order."""
    return _read(spark, as_struct(schema), path=path, query=query, parameters=json.dumps(list(parameters)))
