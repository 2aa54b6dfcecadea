"""Unbounded sources: filters, search scores and tags run on streams as on tables; order and windows don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.egress import Egress
from ..operators.query import Query
from ..sources.files import as_struct

__all__ = ["json_lines", "per_batch", "socket_lines"]


def json_lines(lines: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """The objects among lines of JSON; other lines are left out."""
    text = F.rtrim(F.col(column), F.lit("\r"))
    return lines.select(F.from_json(F.when(F.ltrim(text).startswith("{"), text), as_struct(schema)).alias("x")).where("x is not null").select("x.*")


def socket_lines(spark: SparkSession, host: str, port: int, schema: T.StructType | str) -> DataFrame:
    """Objects from a socket, one on each line. The source can't be replayed after a failure."""
    return json_lines(spark.readStream.format("socket").option("host", host).option("port", port).load(), schema)


def per_batch(stream: DataFrame, build: Callable[[Query], Egress], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Runs a whole query, with order, limit and groups, on each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(build(Query.over(batch)).to_df(), number))
