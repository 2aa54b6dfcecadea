"""Sources with files, a database, and stand-ins for services."""

import json
import sqlite3

import pytest
from pyspark.sql import types as T

from tessera import Dataset, Query
from tessera.sources import HttpPages, http_rows, json_array, ndjson, openapi_request, openapi_schema, redis_rows, redis_sorted_rows, sqlite_query, sqlite_table

ITEM = "id long, name string, score long"
ROWS = [{"id": 1, "name": "alpha", "score": 1}, {"id": 2, "name": "beta", "score": 2}, {"id": 3, "name": "gamma", "score": 3}]


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_json_arrays(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([*ROWS, 5, "x", None, [1], {"id": "no number", "name": 7}], indent=1))
    df = json_array(spark, str(p), ITEM)
    assert sorted((r["id"] or 0, r["name"] or "") for r in df.collect()) == [(0, "7"), (1, "alpha"), (2, "beta"), (3, "gamma")]
    (tmp_path / "b.json").write_text('{"id": 1}')
    with pytest.raises(Exception, match="must be an array"):
        json_array(spark, str(tmp_path / "b.json"), ITEM).collect()
    (tmp_path / "c.json").write_text("[]")
    assert json_array(spark, str(tmp_path / "c.json"), ITEM).count() == 0


def test_ndjson(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text("\n".join([json.dumps(ROWS[0]), "", "  ", "5", json.dumps(ROWS[1]), "[1]", json.dumps(ROWS[2])]))
    assert ids(ndjson(spark, str(p), ITEM)) == [1, 2, 3]
    nested = tmp_path / "n.ndjson"
    nested.write_text(json.dumps({"id": 1, "tags": ["a", "b"], "owner": {"name": "x"}}) + "\n{bad")
    with pytest.raises(Exception, match="MALFORMED|parse"):
        ndjson(spark, str(nested), "id long, tags array<string>, owner struct<name:string>").collect()
    q = Query.over(ndjson(spark, str(nested), "id long, tags array<string>, owner struct<name:string>", lenient=True))
    assert ids(q.equals("tags", "b").equals("owner.name", "x").out().to_df()) == [1]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table items (id integer, name text, score integer)")
        db.executemany("insert into items values (?, ?, ?)", [(1, "alpha", 1), (2, "Beta", 2), (3, "gamma", 3), (4, None, None), (5, "al%pha", 9)])
    return path


def test_sqlite(spark, database):
    df = sqlite_table(spark, database, "items", ITEM, partitions=3)
    q = Query.over(df)
    assert ids(df) == [1, 2, 3, 4, 5]
    cases = {
        "eq": (q.equals("name", "beta"), []),
        "case": (q.contains("name", "b"), []),
        "like": (q.starts_with("name", "al%"), [5]),
        "ends": (q.ends_with("name", "a"), [1, 2, 3, 5]),
        "range": (q.greater_than_or_equal("score", 2).less_than("score", 9), [2, 3]),
        "in": (q.in_("id", [1, 3, 77]), [1, 3]),
        "not_null": (q.value_not_null("name"), [1, 2, 3, 5]),
        "null": (q.is_null("score"), [4]),
        "ne": (q.not_equals("name", "alpha"), [2, 3, 4, 5]),
    }
    for name, (query, want) in cases.items():
        assert ids(query.out().to_df()) == want, name
    top = q.greater_than("score", 0).out().order_by("score", "desc").limit(2).result()
    assert [r["id"] for r in top] == [5, 3]
    assert ids(sqlite_query(spark, database, "select id, name, score from items where score > ?", ITEM, [2])) == [3, 5]


def test_queries_on_one_table_dont_meet(spark, database):
    """Tests of one query don't stay for the next one on the same DataFrame."""
    q = Query.over(sqlite_table(spark, database, "items", ITEM))
    assert ids(q.equals("id", 1).out().to_df()) == [1] and ids(q.out().to_df()) == [1, 2, 3, 4, 5]
    assert ids(q.not_equals("score", 1).out().to_df()) == [2, 3, 4, 5] and ids(q.in_("score", [1, None]).out().to_df()) == [1, 4]


def test_sqlite_reads_what_fits_the_schema(spark, tmp_path):
    """Values of other types are null, for the database's tests as for Spark's."""
    path = str(tmp_path / "m.sqlite")
    values = [5, 5.0, 5.5, "5", "text", None, b"x", -3]
    with sqlite3.connect(path) as db:
        db.execute("create table items (id integer, name, score)")
        db.executemany("insert into items values (?, ?, ?)", [(i, v, v) for i, v in enumerate(values)])
    data = Dataset(sqlite_table(spark, path, "items", ITEM), ("id",))
    plain = Query.over(data.df)
    builds = [
        lambda q: q.greater_than("score", 4), lambda q: q.equals("score", 5), lambda q: q.not_equals("score", 5), lambda q: q.in_("score", [5, None]), lambda q: q.not_in("score", [5]),
        lambda q: q.is_null("score"), lambda q: q.value_not_null("name"), lambda q: q.equals("name", "5"), lambda q: q.not_equals("name", "text"), lambda q: q.not_in("name", [None, "5"]),
        lambda q: q.between("score", -5, 5), lambda q: q.equals("score", "5"), lambda q: q.contains("name", ""), lambda q: q.ends_with("name", "t"),
    ]
    rows = spark.createDataFrame(plain.out().result(), ITEM)
    for k, build in enumerate(builds):
        for column in ("score", "name"):
            want = [r["id"] for r in build(Query.over(Dataset(rows, ("id",)))).out().order_by(column, "desc").limit(5).result()]
            assert [r["id"] for r in build(Query.over(data)).out().order_by(column, "desc").limit(5).result()] == want, k
            assert [r["id"] for r in build(Query.over(data)).out().order_by(column, "desc").to_df().limit(5).collect()] == want, k


def test_windows_reach_the_database(spark, database):
    from tessera.operators import Asked
    from tessera.sources.sqlite import SqliteTable

    table = SqliteTable(spark, database, "items", ITEM)
    q = Query.over(table.materialize()).not_equals("name", "alpha").order_by("score", "desc", "first")
    sql, values = table.statement(Asked(q.plan()[0].children, q.orders, 3, ("id",)))
    assert sql.endswith("limit ?") and "desc nulls first" in sql and values == ["alpha", 3]
    for unfit in (q.matches("name", "x"), q.or_(lambda g: g.equals("id", 1)), q.custom(lambda c: c("id") > 1)):
        assert table.statement(Asked(unfit.plan()[0].children, unfit.orders, 3)) is None
    data = Dataset(sqlite_table(spark, database, "items", ITEM, partitions=2), ("id",))
    assert [r["id"] for r in Query.over(data).out().order_by("score", "desc").offset(1).limit(2).result()] == [3, 2]
    assert len(Query.over(data).out().order_by("score").to_df().collect()) == 5


class Counted:
    """A source that says what was asked of it."""

    def __init__(self, df):
        self.df, self.asked, self.open = df, [], True

    def materialize(self):
        return self.df

    def pushdown(self, asked):
        self.asked.append(asked)
        return self.df.where("score > 1").orderBy("score").limit(asked.limit) if asked.limit and not asked.where else None

    def close(self):
        self.open = False


def test_sources_of_ones_own(spark):
    source = Counted(spark.createDataFrame([(r["id"], r["name"], r["score"]) for r in ROWS], ITEM))
    data = Dataset.of_source(source, ("id",))
    assert [r["id"] for r in Query.over(data).out().order_by("score").limit(1).result()] == [2]
    assert [r["id"] for r in Query.over(data).less_than("id", 3).out().order_by("score").limit(1).result()] == [1]
    assert [len(a.where) for a in source.asked] == [0, 1] and source.asked[0].limit == 1
    assert ids(Query.over(data).out().to_df()) == [1, 2, 3] and source.asked[2].limit is None
    data.close()
    assert not source.open


def service(url, method, headers, body):
    from urllib.parse import parse_qs, urlsplit

    rows = [{"id": i, "name": f"n{i}", "score": i} for i in range(7)]
    asked = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()} | (json.loads(body) if body else {})
    path = urlsplit(url).path
    if path == "/broken":
        return 500, b"no"
    if path == "/cursor":
        at = int(asked.get("cursor", 0))
        return 200, json.dumps({"data": {"items": rows[at : at + 3]}, "next": at + 3 if at + 3 < 7 else ""}).encode()
    if "offset" in asked:
        at, n = int(asked["offset"]), int(asked["limit"])
        return 200, json.dumps(rows[at : at + n]).encode()
    if "page" in asked:
        at, n = int(asked["page"]) - 1, int(asked["size"])
        return 200, json.dumps([*rows[at * n : at * n + n]]).encode()
    return 200, json.dumps([*rows[:3], 5]).encode()


def test_http(spark):
    read = lambda **k: ids(http_rows(spark, HttpPages("http://x" + k.pop("path", "/all"), **k), ITEM, service))
    assert read() == [0, 1, 2]
    assert read(paging="offset", size=3) == list(range(7))
    assert read(paging="offset", size=3, pages=3) == list(range(7))
    assert read(paging="page", size=4, first=1) == list(range(7))
    assert read(paging="offset", size=3, method="POST") == list(range(7))
    assert read(path="/cursor", paging="cursor", data_path="data.items") == list(range(7))
    for bad in ({"path": "/broken"}, {"path": "/cursor"}):
        with pytest.raises(Exception, match="answered 500|no list"):
            read(**bad)
    with pytest.raises(ValueError):
        read(paging="other")


DOC = {
    "openapi": "3.0.1",
    "servers": [{"url": "http://x/"}],
    "paths": {"/items/{kind}": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Item"}}}}}}}}},
    "components": {
        "schemas": {
            "Base": {"type": "object", "properties": {"id": {"type": "integer"}}},
            "Item": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"type": "object", "properties": {"name": {"oneOf": [{"type": "string"}, {"type": "integer"}]}, "tags": {"type": "array", "items": {"type": "string"}}, "owner": {"properties": {"ok": {"type": "boolean"}, "x": {"type": ["number", "null"]}}}, "self": {"$ref": "#/components/schemas/Item"}}}]},
        }
    },
}


def test_openapi():
    got = openapi_schema(DOC, "/items/{kind}")
    assert [(f.name, f.dataType.simpleString()) for f in got.fields][:4] == [("id", "bigint"), ("name", "string"), ("tags", "array<string>"), ("owner", "struct<ok:boolean,x:double>")]
    assert openapi_request(DOC, "/items/{kind}", parameters={"kind": "a", "q": 1}).url == "http://x/items/a"
    with pytest.warns(UserWarning):
        openapi_schema(DOC | {"openapi": "3.1.0"}, "/items/{kind}")
    for bad in (lambda: openapi_schema(DOC | {"openapi": "2.0"}, "/items/{kind}"), lambda: openapi_schema(DOC, "/none"), lambda: openapi_request(DOC, "/items/{kind}")):
        with pytest.raises(ValueError):
            bad()


class Store:
    values = {f"item:{i}": json.dumps(r) for i, r in enumerate(ROWS)} | {"item:x": "5", "other": json.dumps({"id": 9})}

    def scan_iter(self, match):
        import fnmatch

        return (k for k in self.values if fnmatch.fnmatch(k, match))

    def mget(self, keys):
        return [self.values.get(k) for k in keys]

    def zrangebyscore(self, key, low, high, start, num):
        edge = lambda s: float(s.lstrip("("))
        rows = [r for r in ROWS if edge(low) <= r["score"] <= edge(high) and not (low[0] == "(" and r["score"] == edge(low)) and not (high[0] == "(" and r["score"] == edge(high))]
        return [json.dumps(r) for r in rows[start : start + num]]

    def zrevrangebyscore(self, key, high, low, start, num):
        return self.zrangebyscore(key, low, high, 0, 99)[::-1][start : start + num]


def test_stores(spark):
    assert ids(redis_rows(spark, Store, ITEM, match="item:*")) == [1, 2, 3]
    assert len(redis_rows(spark, Store, ITEM, limit=2).collect()) == 2
    rows = redis_sorted_rows(spark, Store, "z", "score", ITEM)
    assert ids(rows) == [1, 2, 3]
    assert ids(Query.over(rows).greater_than("score", 1).less_than_or_equal("score", 3).out().to_df()) == [2, 3]
    assert [r["id"] for r in Query.over(rows).out().order_by("score", "desc").limit(1).result()] == [3]
    # With a limit, the first members are the rows, whatever is asked of them.
    two = Query.over(redis_sorted_rows(spark, Store, "z", "score", ITEM, limit=2))
    assert ids(two.greater_than("score", 1).out().to_df()) == [2] and ids(two.greater_than_or_equal("score", 1).out().to_df()) == [1, 2]
    top = Query.over(Dataset(redis_sorted_rows(spark, Store, "z", "score", ITEM), ("id",)))
    assert [r["id"] for r in top.out().order_by("score", "desc").limit(2).result()] == [3, 2]
    assert [r["id"] for r in top.greater_than("score", 1).less_than("score", 3).out().order_by("score").limit(2).result()] == [2]
    assert [r["id"] for r in top.not_equals("name", "gamma").out().order_by("score", "desc").limit(1).result()] == [2]


def test_streams(spark, tmp_path):
    from tessera.streaming import json_lines, per_batch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(json.dumps, ROWS)) + "\nnot json\n[1]\n\n")
    lines = spark.readStream.format("text").load(str(tmp_path / "in"))
    q = Query.over(json_lines(lines, ITEM)).greater_than("score", 1)
    run = q.out().stream().writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    run.awaitTermination()
    assert ids(spark.table("kept")) == [2, 3]
    with pytest.raises(ValueError):
        q.out().order_by("score").stream()
    seen = []
    run = per_batch(json_lines(lines, ITEM), lambda b: b.out().order_by("score", "desc").limit(2), lambda df, n: seen.extend(r["id"] for r in df.collect())).trigger(availableNow=True).start()
    run.awaitTermination()
    assert seen == [3, 2]


def test_sockets(spark):
    import socket
    import threading
    import time

    from tessera.streaming import socket_lines

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        for r in ROWS:
            link.sendall(json.dumps(r).encode() + b"\r\n")
        link.sendall(b"noise\n")
        time.sleep(20)
        link.close()

    threading.Thread(target=serve, daemon=True).start()
    stream = socket_lines(spark, "127.0.0.1", server.getsockname()[1], ITEM)
    run = Query.over(stream).in_("id", [1, 3]).out().stream().writeStream.format("memory").queryName("heard").start()
    try:
        for _ in range(60):
            if spark.table("heard").count() >= 2:
                break
            time.sleep(0.5)
        assert ids(spark.table("heard")) == [1, 3]
    finally:
        run.stop()
