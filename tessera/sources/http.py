"""JSON over HTTP, page by page."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.parse import urlencode, urlsplit, urlunsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import as_struct
from .rows import row_of

Fetch = Callable[[str, str, dict, bytes | None], tuple[int, bytes]]
_names = itertools.count()


def fetch(url: str, method: str, headers: dict, body: bytes | None) -> tuple[int, bytes]:
    try:
        with urlopen(Request(url, body, headers, method=method), timeout=60) as answer:
            return answer.status, answer.read()
    except HTTPError as e:
        return e.code, e.read()


@dataclass(frozen=True)
class HttpPages:
    """How a service is asked, and how it turns pages: none, offset, page or cursor.

    Pages end with one that has fewer than ``size`` items, or without a next cursor. With ``pages``, that many are
    fetched in as many tasks, which offset and page allow; otherwise one task follows them.
    """

    url: str
    method: str = "GET"
    headers: dict = field(default_factory=dict)
    body: dict | None = None
    query: dict = field(default_factory=dict)
    #: Where the items stand in an answer, and the next cursor, as dot paths.
    data_path: str = ""
    paging: str = "none"
    size: int = 100
    first: int = 0
    parameter: str = ""
    size_parameter: str = ""
    cursor_path: str = ""
    pages: int = 0

    def ask(self, get: Fetch, extra: dict) -> object:
        parts = urlsplit(self.url)
        query = "&".join(x for x in (parts.query, urlencode({**self.query, **(extra if self.method == "GET" else {})})) if x)
        body = None if self.method == "GET" else json.dumps({**(self.body or {}), **extra}).encode()
        headers = {**({"content-type": "application/json"} if body else {}), **self.headers}
        status, data = get(urlunsplit(parts._replace(query=query)), self.method, headers, body)
        if not 200 <= status < 300:
            raise OSError(f"{self.url} answered {status}")
        return json.loads(data)

    def items(self, answer: object) -> list:
        found = at(answer, self.data_path)
        if not isinstance(found, list):
            raise ValueError(f"{self.url}: no list of items" + (f" at {self.data_path}" if self.data_path else ""))
        return found

    def page(self, get: Fetch, k: int) -> list:
        name = self.parameter or self.paging
        where = self.first + (k * self.size if self.paging == "offset" else k)
        return self.items(self.ask(get, {name: where, self.size_parameter or ("limit" if self.paging == "offset" else "size"): self.size}))

    def read(self, get: Fetch, part: int | None) -> Iterator[dict]:
        if part is not None:
            yield from self.page(get, part)
        elif self.paging == "none":
            yield from self.items(self.ask(get, {}))
        elif self.paging == "cursor":
            cursor = None
            while True:
                answer = self.ask(get, {} if cursor is None else {self.parameter or "cursor": cursor})
                yield from self.items(answer)
                cursor = at(answer, self.cursor_path or "next")
                if cursor in (None, ""):
                    return
        else:
            for k in itertools.count():
                found = self.page(get, k)
                yield from found
                if len(found) < self.size:
                    return


def at(value: object, path: str) -> object:
    for name in path.split(".") if path else []:
        value = value.get(name) if isinstance(value, dict) else None
    return value


class Page(InputPartition):
    def __init__(self, number: int | None):
        super().__init__(number)


def http_rows(spark: SparkSession, pages: HttpPages, schema: T.StructType | str, get: Fetch = fetch) -> DataFrame:
    """The objects among a service's items. ``get`` (url, method, headers, body) -> (status, bytes) runs on the executors."""
    if pages.paging not in ("none", "offset", "page", "cursor"):
        raise ValueError("paging is none, offset, page or cursor")
    wanted, name = as_struct(schema), f"tessera_http_{next(_names)}"

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            split = pages.pages if pages.paging in ("offset", "page") else 0
            return [Page(k) for k in range(split)] if split else [Page(None)]

        def read(self, partition: Page) -> Iterator[tuple]:
            for x in pages.read(get, partition.value):
                if isinstance(x, dict):
                    yield row_of(x, wanted)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return wanted

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
