"""Small helpers that let the operators run plain Python over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows are handed to Python in pieces of at most this many, so that a batch of very long texts stays small.
ROWS = 256
#: Spark's batches: a row's columns are held a few times on their way to Python and back, so smaller ones than usual do.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, unless someone has set them."""
    for name, (usual, ours) in BATCHES.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_columns(df: DataFrame, used: list[str], made: StructType, f: Callable[..., list], state: Callable[[], object] | None = None, rows: int = ROWS, arrow_out: bool = False) -> DataFrame:
    """Appends columns: ``f(state, *lists)`` gets the used columns as Python lists and returns a list of tuples in ``made``'s order.

    With ``arrow_out``, it gets Arrow arrays and returns one for each made column. A made column replaces one of the
    same name, whatever its case.
    """
    small_batches(df.sparkSession)
    taken = {x.name.lower() for x in made.fields}
    kept = [x for x in df.schema.fields if x.name.lower() not in taken]
    extra = [x for x in used if x.lower() in taken]
    renamed = {x: f"__used_{i}" for i, x in enumerate(extra)}
    source = df.select(*[quoted(df, x.name) for x in kept], *[quoted(df, x).alias(y) for x, y in renamed.items()])
    inputs, n = [renamed.get(x, x) for x in used], len(kept)
    schema = StructType(kept + made.fields)
    arrow = to_arrow_schema(StructType(made.fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state() if state else None
        for part in pieces(batches, rows):
            columns = [part.column(part.schema.get_field_index(x)) for x in inputs]
            if arrow_out:
                new = [x.cast(arrow.field(i).type) for i, x in enumerate(f(held, *columns))]
            else:
                got = f(held, *[x.to_pylist() for x in columns])
                new = [pa.array([row[i] for row in got], type=arrow.field(i).type) for i in range(len(arrow))]
                del got
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=[*part.schema.names[:n], *arrow.names])
            del columns, new
        del held
        give_back()

    return source.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on for later stages, with other needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def quoted(df: DataFrame, name: str):
    return df["`" + name.replace("`", "``") + "`"]


def fields(**kinds) -> StructType:
    return StructType([StructField(k, v, True) for k, v in kinds.items()])


def grouped(batches: Iterable[pa.RecordBatch], key: str, f: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], least: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Hands rows sorted by a key to ``f`` in tables of whole groups, with the starts of the groups."""
    held: list[pa.RecordBatch] = []
    n = 0

    def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            k = t[key].to_numpy()
            out = f(t, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])))
            if out is not None and out.num_rows:
                yield out

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            k = t[key].to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield from give(t.slice(0, cut))
                rest = t.slice(cut).combine_chunks().to_batches()
                held, n = rest, sum(b.num_rows for b in rest)
    if held:
        yield from give(pa.Table.from_batches(held).combine_chunks())
