"""Python tests of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def python_test(test: Callable[[dict], bool]):
    """A Python test of rows, in batches."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([bool(test(r)) for r in rows.to_dict("records")], dtype=bool)

    return run
