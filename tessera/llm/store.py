"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named and one machine does all, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The tables that are there, by path, and those that ``temporary`` blocks have made.
_there: dict[str, DataFrame] = {}
_blocks: list[list[DataFrame]] = []


def saved(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back: what follows doesn't depend on executors that made it.

    It stays until it is dropped, or until the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    _there[path] = out
    for block in _blocks:
        block.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by ``saved`` once nothing reads it any more; one that is gone already is none."""
    spark, path = df.sparkSession, df._saved_path
    if _there.pop(path, None) is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops what was saved within the block, but for the tables that the given function was called with."""
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._saved_path)
        return df

    _blocks.append(made)
    try:
        yield keep
    finally:
        _blocks.remove(made)
        for df in made:
            if df._saved_path not in kept:
                dropped(df)


@atexit.register
def clean() -> None:
    """Drops all that is left when the program ends, if its session is still there."""
    for df in list(_there.values()):
        with suppress(Exception):
            dropped(df)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of rounds that are over: it does so when the driver has forgotten them."""
    gc.collect()
    spark._jvm.System.gc()


def bit_map(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value that a column of longs has, modulo ``bits``, a power of two from 32768 on; its size doesn't depend on the data.

    The executors put it together in pieces of 4 KB.
    """
    place = F.pmod(F.col(column), F.lit(bits)) + 1  # of a power of two, also for what is unsigned
    pieces = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out
