"""JSON values of a Redis-like store. The client comes from a function that runs on the executor."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dataset import Asked, from_source
from ..plans.ast import Leaf
from .files import as_struct
from .rows import row_of

_names = itertools.count()
#: Values fetched together.
BATCH = 500


def registered(spark: SparkSession, wanted: T.StructType, made: Callable[[], DataSourceReader]) -> DataFrame:
    name = f"tessera_store_{next(_names)}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return wanted

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return made()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def parsed(values: Iterable, schema: T.StructType, parse: Callable) -> Iterator[tuple]:
    for v in values:
        x = None if v is None else parse(v)
        if isinstance(x, dict):
            yield row_of(x, schema)


def redis_rows(spark: SparkSession, client: Callable, schema: T.StructType | str, match: str = "*", limit: int | None = None, parse: Callable = json.loads) -> DataFrame:
    """The objects at the keys that match. ``client()`` has scan_iter(match=) and mget(keys)."""
    wanted = as_struct(schema)

    class Reader(DataSourceReader):
        def read(self, partition: InputPartition) -> Iterator[tuple]:
            store = client()
            keys = itertools.islice(store.scan_iter(match=match), limit)
            while part := list(itertools.islice(keys, BATCH)):
                yield from parsed(store.mget(part), wanted, parse)

    return registered(spark, wanted, Reader)


def members(store, key: str, low: str, high: str, descending: bool, limit: int | None) -> Iterator:
    """Members within bounds by score, a batch at a time."""
    start = 0
    while limit is None or start < limit:
        n = BATCH if limit is None else min(BATCH, limit - start)
        part = store.zrevrangebyscore(key, high, low, start=start, num=n) if descending else store.zrangebyscore(key, low, high, start=start, num=n)
        yield from part
        if len(part) < n:
            return
        start += n


class RedisSorted:
    """A sorted set as a source that answers for a range of the score, an order by it and a limit."""

    def __init__(self, spark: SparkSession, client: Callable, key: str, score_field: str, schema: T.StructType, limit: int | None, parse: Callable):
        self.spark, self.client, self.key, self.score_field, self.schema, self.limit, self.parse = spark, client, key, score_field, schema, limit, parse

    def materialize(self, low: str = "-inf", high: str = "inf", descending: bool = False, enough: int | None = None) -> DataFrame:
        """With ``enough``, so many objects and all that share the last one's score: other keys order them."""
        client, key, field, limit, wanted, parse = self.client, self.key, self.score_field, self.limit, self.schema, self.parse

        class Reader(DataSourceReader):
            def read(self, partition: InputPartition) -> Iterator[tuple]:
                seen, last = 0, None
                for v in members(client(), key, low, high, descending, limit) if enough != 0 else ():
                    x = None if v is None else parse(v)
                    if not isinstance(x, dict):
                        continue
                    if enough is not None and seen >= enough and x.get(field) != last:
                        return
                    seen, last = seen + 1, x.get(field)
                    yield row_of(x, wanted)

        return registered(self.spark, wanted, Reader)

    def bounds(self, where: tuple) -> tuple[tuple[str, str], bool]:
        """The range that tests of the score leave, a bracket before an end that isn't in it; and whether there are no other tests."""
        low, high, alone = (float("-inf"), False), (float("inf"), False), True
        for x in where:
            values = x.value if isinstance(x, Leaf) and x.op == "between" else (x.value,) if isinstance(x, Leaf) else ()
            if not values or x.path != self.score_field or x.op not in ("gt", "gte", "lt", "lte", "between", "eq") or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and v == v for v in values):
                alone = False
                continue
            if x.op in ("gt", "gte", "between", "eq"):
                low = max(low, (float(values[0]), x.op == "gt"))
            if x.op in ("lt", "lte", "between", "eq"):
                high = min(high, (float(values[-1]), x.op == "lt"), key=lambda b: (b[0], not b[1]))
        return tuple(f"{'(' if beyond else ''}{edge}" for edge, beyond in (low, high)), alone

    def pushdown(self, asked: Asked) -> DataFrame | None:
        if self.limit is not None:
            return None  # the first members are the rows, whatever is asked of them
        bounds, alone = self.bounds(asked.where)
        by_score = len(asked.orders) == 1 and asked.orders[0].path == self.score_field and not asked.orders[0].date and not asked.orders[0].nulls_first
        if asked.limit is None or not alone or not by_score:
            return self.materialize(*bounds)
        return self.materialize(*bounds, asked.orders[0].descending, asked.limit)


def redis_sorted_rows(spark: SparkSession, client: Callable, key: str, score_field: str, schema: T.StructType | str, limit: int | None = None, parse: Callable = json.loads) -> DataFrame:
    """The objects of a sorted set, each of which holds its score in ``score_field``, in its order.

    ``client()`` has zrangebyscore(key, low, high, start=, num=) and zrevrangebyscore(key, high, low, start=, num=). Of a
    query over these rows, a range of the score reaches the store, and with it an order by score with a limit. With a
    ``limit`` given here, the first so many members are the rows, and nothing reaches the store.
    """
    return from_source(RedisSorted(spark, client, key, score_field, as_struct(schema), limit, parse))
