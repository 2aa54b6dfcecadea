"""What comes after the predicates: search, order, windows, pages, groups, metadata."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..functions.paths import PathError, resolve, sort_key
from ..functions.values import timestamp_of
from ..plans import telemetry
from ..plans.ast import conjuncts
from ..plans.compile import Compiler
from .dataset import Asked, Dataset
from .query import Order, Query
from .search import folded, score, search_of, tag_mask, tags_of

SCORE, MASK = "_score", "_tag_mask"
#: A row's place in the order, from 0.
PLACE = "_place"


class NoRowError(LookupError):
    """There is no first row."""


def whole(n: float) -> int:
    """A count: rounded down, at least 0; what isn't finite counts as 0."""
    return max(0, math.floor(n)) if isinstance(n, (int, float)) and math.isfinite(n) else 0


def page_number(n: float) -> int:
    return math.floor(n) if isinstance(n, (int, float)) and math.isfinite(n) and n >= 1 else 1


def placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """The rows in order with their places, and their number. They are sorted once, by ranges, and kept by the
    executors; all that reaches the driver is the number of rows of each range."""
    kept = df.orderBy(*order).withColumn(PLACE, F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    # That number holds the range above 33 bits, and the place within the range below.
    counts = kept.groupBy(F.shiftright(PLACE, 33).cast("int").alias("range")).count().collect()
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["range"]):
        starts[r["range"]], total = total, total + r["count"]
    first = [starts.get(i, 0) for i in range(max(starts, default=0) + 1)]
    start = F.get(F.lit(first), F.shiftright(PLACE, 33).cast("int")) if any(first) else F.lit(0)
    out = kept.withColumn(PLACE, start.cast("long") + F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1)))
    out._kept = kept
    return out, total


@dataclass(frozen=True)
class Egress:
    query: Query
    max_rows: int | None = None
    skip: int = 0

    def _with(self, **changes) -> Egress:
        return replace(self, query=replace(self.query, **changes))

    # Orders and windows.

    def order_by(self, path: str, direction: str = "asc", nulls: str = "last") -> Egress:
        return self._with(orders=(*self.query.orders, Order.of(path, direction, nulls)))

    def order_by_date(self, path: str, direction: str = "asc", nulls: str = "last") -> Egress:
        return self._with(orders=(*self.query.orders, Order.of(path, direction, nulls, date=True)))

    then_by, then_by_date = order_by, order_by_date

    def limit(self, n: float) -> Egress:
        return replace(self, max_rows=whole(n))

    def offset(self, n: float) -> Egress:
        return replace(self, skip=whole(n))

    def page(self, page: float, size: float) -> Egress:
        size = page_number(size)
        return replace(self, max_rows=size, skip=(page_number(page) - 1) * size)

    # Search.

    def search(self, what: str | list | dict) -> Egress:
        return self._with(searches=(*self.query.searches, search_of(what, self.query.fuzzy, self.query.tagger)))

    def tags(self, has: Iterable[str] = (), has_any: Iterable[str] = (), not_: Iterable[str] = (), not_any: Iterable[str] = ()) -> Egress:
        return self._with(searches=(*self.query.searches, tags_of(self.query.tagger, has, has_any, not_, not_any)))

    # Plans.

    @property
    def data(self) -> Dataset:
        return self.query.data

    def filtered(self, limit: int | None = None) -> DataFrame:
        """The rows that the predicates keep, the first ``limit`` at least, with score and tags where a search asks for them."""
        node, diagnostics = self.query.plan()
        telemetry.record("plan", plan_id=diagnostics.plan_id, ordered=diagnostics.ordered, contradictions=diagnostics.contradictions)
        df = self.data.rows(Asked(conjuncts(node), self.query.orders if limit is not None else (), limit, self.data.unique_key))
        compiler = Compiler(self.data.schema)
        for x in conjuncts(node):
            df = df.where(compiler.column(x, strict=False))
        asked = folded(self.query.searches)
        if asked.query is not None:
            fuzzy = self.query.fuzzy
            df = df.withColumn(SCORE, score(fuzzy, asked.query, self.data.schema))
            if fuzzy.require_all:
                df = df.where(F.col(SCORE) > 0)
            least = asked.min_score if asked.min_score is not None else fuzzy.min_score
            df = df.where(F.col(SCORE) >= float(least))
        if asked.by_tags:
            df = df.withColumn(MASK, tag_mask(self.query.tagger, self.data.schema))
            bits = F.col(MASK)
            if asked.has:
                df = df.where(bits.bitwiseAND(F.lit(asked.has).cast("long")) == asked.has)
            if asked.has_any:
                df = df.where(bits.bitwiseAND(F.lit(asked.has_any).cast("long")) != 0)
            if asked.none_of:
                df = df.where(bits.bitwiseAND(F.lit(asked.none_of).cast("long")) == 0)
        return df if df.isStreaming else self.data.numbered(df)

    def sort_columns(self) -> list[Column]:
        """The orders asked for, then the score, then the order of reading."""
        out = []
        for o in self.query.orders:
            key = sort_key(self.data.schema, o.path, o.date)
            if o.descending:
                out.append(key.desc_nulls_first() if o.nulls_first else key.desc_nulls_last())
            else:
                out.append(key.asc_nulls_first() if o.nulls_first else key.asc_nulls_last())
        if folded(self.query.searches).query is not None and self.query.fuzzy.order != "existing":
            out.append(F.col(SCORE).desc())
        return out + self.data.order()

    def ordered(self) -> DataFrame:
        return self.filtered().orderBy(*self.sort_columns())

    def windowed(self) -> DataFrame:
        """All columns, our own included; without a window or an order, rows stay where they are."""
        df = self.filtered(None if self.max_rows is None or self.query.searches else self.skip + self.max_rows)
        searched = folded(self.query.searches).query is not None and self.query.fuzzy.order != "existing"
        if self.max_rows is None and not self.skip and not self.query.orders and not searched:
            return df
        if self.skip and self.max_rows is None:
            # Spark would send all rows through one task. What is kept stays until ``spark.catalog.clearCache()``.
            return placed(df, self.sort_columns())[0].where(F.col(PLACE) >= self.skip).drop(PLACE)
        df = df.orderBy(*self.sort_columns())
        if self.skip:
            df = df.offset(self.skip)
        return df if self.max_rows is None else df.limit(self.max_rows)

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self.data.df.columns])

    def to_df(self) -> DataFrame:
        return self._plain(self.windowed())

    def stream(self) -> DataFrame:
        """The rows of an unbounded source as they come; they have no order and no end."""
        if self.query.orders or self.max_rows is not None or self.skip:
            raise ValueError("an unbounded source can't be sorted or counted off; do so per batch, in foreachBatch")
        return self._plain(self.filtered())

    # Actions.

    def result(self) -> list[Row]:
        """All rows, in the driver's memory; ``write`` has no such bound."""
        with telemetry.span("result"):
            out = self.to_df().collect()
        telemetry.record("rows", n=len(out))
        return out

    def write(self, path: str | None = None, format: str = "parquet") -> int:
        """Has the executors write all rows, whatever their number, and returns it; ``noop`` makes the rows and keeps none."""
        seen = Observation()
        with telemetry.span("result"):
            self.to_df().observe(seen, F.count(F.lit(1)).alias("rows")).write.format(format).mode("append" if format == "noop" else "error").save(path)
        n = seen.get.get("rows", 0)
        telemetry.record("rows", n=n)
        return n

    def first(self) -> Row | None:
        if self.max_rows == 0:
            return None
        got = replace(self, max_rows=1).to_df().take(1)
        return got[0] if got else None

    def first_or_throw(self) -> Row:
        row = self.first()
        if row is None:
            raise NoRowError("no row matches")
        return row

    def count(self) -> int:
        return self.to_df().count()

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    def paginate(self, page_size: float, page: float = 1, total: str = "full") -> Paginator:
        if total not in ("none", "full", "lazy"):
            raise ValueError("total is none, full or lazy")
        return Paginator(self, page_number(page_size), page_number(page), total)

    def group_by(self, path: str, date: bool = False) -> Groups:
        return Groups(self, path, date)

    def result_with_metadata(self) -> DataFrame:
        """The rows with ``_score`` and ``_tag_mask``, null where no search asked for them."""
        df = self.windowed()
        for name, kind in ((SCORE, "double"), (MASK, "long")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        return df.select(*[F.col(f"`{c}`") for c in self.data.df.columns], SCORE, MASK)


class Paginator:
    """Pages over the ordered result, which is sorted and numbered once, at the first page; ``close`` lets go of it."""

    def __init__(self, egress: Egress, size: int, page: int, total: str):
        self.egress, self.size, self.page = egress, size, page
        self._rows: list[Row] | None = None
        self._placed: tuple[DataFrame, int] | None = None
        self.total = None if total == "none" else self.count()

    def placed(self) -> tuple[DataFrame, int]:
        if self._placed is None:
            self._placed = placed(self.egress.filtered(), self.egress.sort_columns())
        return self._placed

    def count(self) -> int:
        left = max(0, self.placed()[1] - self.egress.skip)
        return left if self.egress.max_rows is None else min(left, self.egress.max_rows)

    def data_frame(self) -> DataFrame:
        inner, skip = self.egress, (self.page - 1) * self.size
        left = self.size if inner.max_rows is None else max(0, min(self.size, inner.max_rows - skip))
        start = inner.skip + skip
        return inner._plain(self.placed()[0].where((F.col(PLACE) >= start) & (F.col(PLACE) < start + left)).orderBy(PLACE))

    def close(self) -> None:
        if self._placed is not None:
            self._placed[0]._kept.unpersist()
            self._placed = None

    def __enter__(self) -> Paginator:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def data(self) -> list[Row]:
        if self._rows is None:
            self._rows = self.data_frame().collect()
        return self._rows

    def next(self) -> list[Row]:
        self.page, self._rows = self.page + 1, None
        return self.data

    def previous(self) -> list[Row]:
        self.page, self._rows = max(1, self.page - 1), None
        return self.data

    def __iter__(self) -> Iterator[Row]:
        return iter(self.data)


class Groups:
    """Rows by the values of a path: a row is in as many groups as its path has values, as often as these occur.

    Nulls, NaN and objects are no keys; dates become milliseconds since 1970.
    """

    def __init__(self, egress: Egress, path: str, date: bool):
        v = resolve(egress.data.schema, path)
        if v.kind in ("other", "variant"):
            raise PathError(f"{path}: a {v.type.simpleString()} is no key")
        self.egress, self.values, self.date = egress, v, date

    def key(self, c: Column) -> Column:
        t = self.values.type
        kind = self.values.kind
        if kind == "date" or self.date and kind in ("number", "string"):
            return F.unix_millis(timestamp_of(c, t))
        return F.when(~F.isnan(c), c) if isinstance(t, (T.FloatType, T.DoubleType)) else c

    def long_form(self) -> DataFrame:
        """(_key, _pos, the row's columns): one row for each group that a row is in, with the value's place in its path."""
        df = self.egress.windowed()
        if self.values.many or self.values.nothing:
            keyed = df.select("*", F.posexplode(F.transform(self.values.listed(), self.key)).alias("_pos", "_key"))
        else:
            keyed = df.select("*", F.lit(0).alias("_pos"), self.key(self.values.col).alias("_key"))
        return keyed.where("_key is not null")

    def rows(self) -> DataFrame:
        keyed = self.long_form()
        return keyed.select("_key", *[F.col(f"`{c}`") for c in self.egress.data.df.columns])

    def counts(self) -> DataFrame:
        return self.long_form().groupBy("_key").agg(F.count("*").alias("_count"))

    def _ranked(self) -> DataFrame:
        """The long form with each row's rank in its group, by the order that was asked for."""
        place = Window.partitionBy("_key").orderBy(*self.egress.sort_columns(), "_pos")
        return self.long_form().withColumn("_rank", F.row_number().over(place))

    def collected(self) -> DataFrame:
        """(_key, _rows): the rows of each group in the order asked for, ties by the key columns.

        A group must fit into one task; ``rows`` has no such bound.
        """
        item = F.struct("_rank", F.struct(*[F.col(f"`{c}`") for c in self.egress.data.df.columns]).alias("row"))
        items = self._ranked().groupBy("_key").agg(F.array_sort(F.collect_list(item)).alias("_items"))
        return items.select("_key", F.transform("_items", lambda x: x["row"]).alias("_rows"))

    def collect(self) -> dict[Any, list[Row]]:
        """The groups in the order in which their first rows come."""
        firsts = self._ranked().where("_rank = 1").orderBy(*self.egress.sort_columns(), "_pos").select("_key").collect()
        rows = {r["_key"]: r["_rows"] for r in self.collected().collect()}
        return {r["_key"]: rows[r["_key"]] for r in firsts}
