"""A DataFrame with what a query needs to know beside it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that numbers rows as they are read, where no key does.
ROW = "_rid"


@dataclass(frozen=True)
class Asked:
    """What a query asks of its source: rows that pass all tests or, with a limit, the first so many of them in an order, ties by the key."""

    where: tuple
    orders: tuple = ()
    limit: int | None = None
    unique_key: tuple[str, ...] = ()


def from_source(source: Any) -> DataFrame:
    """All rows of a source, as a DataFrame that knows it; datasets over that DataFrame ask the source."""
    df = source.materialize()
    df._tessera_source = source
    return df


@dataclass(frozen=True)
class Dataset:
    """``unique_key``: columns that tell rows apart and order ties; without them rows are numbered as they are read.

    ``source`` is where the rows come from, if that can answer for more than all rows: ``materialize()`` gives these as
    a DataFrame. Others are optional: ``pushdown(asked)`` gives a new DataFrame with at least the rows asked for, which
    are tested, sorted and counted off again, or None; ``stream()`` an unbounded DataFrame; ``close()`` lets go.
    """

    df: DataFrame
    unique_key: tuple[str, ...] = ()
    estimated_count: int | None = None
    options: dict = field(default_factory=dict, compare=False)
    source: Any = field(default=None, compare=False)

    def __post_init__(self):
        if self.source is None:
            object.__setattr__(self, "source", getattr(self.df, "_tessera_source", None))

    @classmethod
    def of_source(cls, source: Any, unique_key: tuple[str, ...] = ()) -> Dataset:
        return cls(source.materialize(), tuple(unique_key), source=source)

    @classmethod
    def of_stream(cls, source: Any, unique_key: tuple[str, ...] = ()) -> Dataset:
        return cls(source.stream(), tuple(unique_key))

    def rows(self, asked: Asked) -> DataFrame:
        """The source's own answer, or all rows."""
        got = self.source.pushdown(asked) if hasattr(self.source, "pushdown") else None
        return self.df if got is None else got

    def close(self) -> None:
        if hasattr(self.source, "close"):
            self.source.close()

    @classmethod
    def of(cls, source: Dataset | DataFrame) -> Dataset:
        return source if isinstance(source, Dataset) else cls(source)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable, schema: T.StructType | str, unique_key: tuple[str, ...] = ()) -> Dataset:
        rows = list(rows)
        return cls(spark.createDataFrame(rows, schema), tuple(unique_key), len(rows))

    @classmethod
    def from_schema(cls, spark: SparkSession, schema: T.StructType | str, unique_key: tuple[str, ...] = ()) -> Dataset:
        """An empty dataset, to load rows into."""
        return cls.from_rows(spark, [], schema, unique_key)

    def load(self, rows: Iterable) -> Dataset:
        """The same columns with other rows."""
        return Dataset.from_rows(self.df.sparkSession, rows, self.df.schema, self.unique_key)

    def load_from(self, df: DataFrame) -> Dataset:
        return Dataset(df.to(self.df.schema), self.unique_key)

    def clear(self) -> Dataset:
        return self.load([])

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def length(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def numbered(self, kept: DataFrame) -> DataFrame:
        """Rows kept from the dataset with something to order them by: the key, or a number that follows the order of reading.

        Filters come before, for they can't pass a numbering on their way to the scan.
        """
        return kept if self.unique_key or ROW in kept.columns else kept.withColumn(ROW, F.monotonically_increasing_id())

    def order(self) -> list[Column]:
        return [F.col(f"`{c}`").asc_nulls_first() for c in (self.unique_key or (ROW,))]
