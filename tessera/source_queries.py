"""Queries over sources: the driver's tables are written once as files, a database and stand-ins for services, and read from there."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
from functools import partial
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import Asked, Dataset, Query, QueryChain
from .plans import telemetry
from .queries import KEYS, case, fuzzy_sql, query, tagged
from .sources import HttpPages, http_rows, json_array, ndjson, openapi_request, openapi_schema, parquet, redis_rows, redis_sorted_rows, sqlite_query, sqlite_table
from .sources.scratch import local_path, written
from .streaming import json_lines, per_batch

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
PAGE = 400


def as_dicts(spark: SparkSession, d: str, table: str):
    return (r.asDict() for r in parquet(spark, f"{d}/{table}.parquet").toLocalIterator())


# Files.


def array_file(spark: SparkSession, d: str) -> str:
    def write(path: str) -> None:
        with open(local_path(path), "w") as out:
            json.dump(list(as_dicts(spark, d, "customer")), out)

    return written(spark, f"{d}:customer.json", write)


@case("source_json_array", "select c_custkey, c_acctbal from customer where c_acctbal >= 5000 and c_mktsegment <> 'BUILDING'")
def source_json_array(spark: SparkSession, d: str) -> DataFrame:
    q = Query.over(json_array(spark, array_file(spark, d), CUSTOMER))
    return q.greater_than_or_equal("c_acctbal", 5000).not_equals("c_mktsegment", "BUILDING").out().to_df().select("c_custkey", "c_acctbal")


def line_files(spark: SparkSession, d: str) -> str:
    events = parquet(spark, f"{d}/events.parquet").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"))
    return written(spark, f"{d}:events.ndjson", lambda path: events.write.json(path))


EVENT = "event_id long, event_type string, value double, ts string"


@case("source_ndjson", "select event_id, value from events where event_type = 'click' and ts >= (select date_trunc('day', min(ts)) + interval 2 day from events)")
def source_ndjson(spark: SparkSession, d: str) -> DataFrame:
    start = parquet(spark, f"{d}/events.parquet").agg((F.date_trunc("day", F.min("ts")) + F.expr("interval 2 day")).alias("s")).first()["s"]
    q = Query.over(ndjson(spark, line_files(spark, d), EVENT))
    return q.equals("event_type", "click").date_after_or_equal("ts", start).out().to_df().select("event_id", "value")


@case("stream_filter", "select event_id, event_type from events where event_type in ('click', 'error') and value > 10")
def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    """The lines as an unbounded source; what passes is written, and the stream ends with what there was."""

    def write(path: str) -> None:
        lines = spark.readStream.format("text").load(line_files(spark, d))
        kept = Query.over(json_lines(lines, EVENT)).in_("event_type", ["click", "error"]).greater_than("value", 10).out().stream()
        run = kept.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path)
        run.awaitTermination()

    return spark.read.schema(EVENT).parquet(written(spark, f"{d}:stream_filter", write)).select("event_id", "event_type")


@case("stream_per_batch", "select event_id from events where event_type = 'purchase' order by value desc, event_id limit 40")
def stream_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """Order and limit within a micro-batch, which here holds all lines."""

    def write(path: str) -> None:
        lines = spark.readStream.format("text").load(line_files(spark, d))
        top = per_batch(json_lines(lines, EVENT), lambda b: b.equals("event_type", "purchase").out().order_by("value", "desc").then_by("event_id").limit(40), lambda df, _: df.write.mode("append").parquet(path))
        top.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()

    return spark.read.schema(EVENT).parquet(written(spark, f"{d}:stream_per_batch", write)).select("event_id")


# A database.


def database(spark: SparkSession, d: str) -> str:
    def write(path: str) -> None:
        with sqlite3.connect(local_path(path)) as db:
            db.execute("create table part (p_partkey integer, p_name text, p_brand text, p_type text, p_size integer, p_retailprice real)")
            db.executemany("insert into part values (:p_partkey, :p_name, :p_brand, :p_type, :p_size, :p_retailprice)", as_dicts(spark, d, "part"))
            db.execute("update part set p_brand = null where p_size = 7")

    return local_path(written(spark, f"{d}:part.sqlite", write))


BRANDS = "(select p_partkey, p_name, p_type, p_size, p_retailprice, case when p_size <> 7 then p_brand end as p_brand from part)"


def sqlite_case(name: str, build, where: str) -> None:
    case(name, f"select p_partkey from {BRANDS} where {where}")(lambda spark, d: build(Query.over(Dataset(sqlite_table(spark, database(spark, d), "part", PART, partitions=4), KEYS["part"]))).out().to_df().select("p_partkey"))


sqlite_case("source_sqlite_compare", lambda q: q.greater_than("p_size", 10).less_than_or_equal("p_retailprice", 1500).starts_with("p_type", "S"), "p_size > 10 and p_retailprice <= 1500 and starts_with(p_type, 'S')")
sqlite_case("source_sqlite_ne", lambda q: q.not_equals("p_brand", "Brand#11").contains("p_name", "a"), "p_brand is distinct from 'Brand#11' and contains(p_name, 'a')")
sqlite_case("source_sqlite_not_in", lambda q: q.not_in("p_size", [1, 2, 3]).ends_with("p_brand", "3"), "p_size not in (1, 2, 3) and suffix(p_brand, '3')")
sqlite_case("source_sqlite_null", lambda q: q.is_null("p_brand"), "p_brand is null")
sqlite_case("source_sqlite_matches", lambda q: q.matches("p_brand", r"#[1-3]\d$").not_equals("p_size", 20), r"regexp_matches(p_brand, '#[1-3]\d$') and p_size <> 20")


@case("source_sqlite_top", f"select p_partkey, p_brand from {BRANDS} where p_size >= 5 and p_brand is distinct from 'Brand#11' order by p_brand desc nulls first, p_retailprice, p_partkey limit 60 offset 15")
def source_sqlite_top(spark: SparkSession, d: str) -> DataFrame:
    """Tests, orders and the window reach the database."""
    q = Query.over(Dataset(sqlite_table(spark, database(spark, d), "part", PART), KEYS["part"])).greater_than_or_equal("p_size", 5).not_equals("p_brand", "Brand#11")
    return q.out().order_by("p_brand", "desc", "first").then_by("p_retailprice").offset(15).limit(60).to_df().select("p_partkey", "p_brand")


@case("source_sqlite_query", "select p_partkey, p_size from part where p_size between 10 and 20")
def source_sqlite_query(spark: SparkSession, d: str) -> DataFrame:
    return sqlite_query(spark, database(spark, d), "select p_partkey, p_size from part where p_size between ? and ?", "p_partkey long, p_size int", [10, 20])


# Services.


def answer(folder: str, url: str, method: str, headers: dict, body: bytes | None) -> tuple[int, bytes]:
    """A service that serves the pages of a folder by offset, by page or by cursor."""
    asked = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()} | (json.loads(body) if body else {})
    k = int(asked["offset"]) // PAGE if "offset" in asked else int(asked.get("page", asked.get("cursor", 0)))
    page = Path(folder, f"{k}.json")
    items = page.read_bytes() if page.exists() else b"[]"
    more = Path(folder, f"{k + 1}.json").exists()
    return 200, b'{"data": %b, "next": %b}' % (items, str(k + 1).encode() if more else b"null")


def pages_folder(spark: SparkSession, d: str) -> str:
    def write(path: str) -> None:
        folder, rows = Path(local_path(path)), list(as_dicts(spark, d, "customer"))
        folder.mkdir()
        for k in range(0, len(rows), PAGE):
            (folder / f"{k // PAGE}.json").write_text(json.dumps(rows[k : k + PAGE]))

    return local_path(written(spark, f"{d}:customer pages", write))


def http_case(name: str, **how) -> None:
    @case(name, "select c_custkey, c_name from customer where c_nationkey < 10")
    def read(spark: SparkSession, d: str) -> DataFrame:
        rows = http_rows(spark, HttpPages("http://service/customers", data_path="data", size=PAGE, **how), CUSTOMER, partial(answer, pages_folder(spark, d)))
        return Query.over(rows).less_than("c_nationkey", 10).out().to_df().select("c_custkey", "c_name")


http_case("source_http_offset", paging="offset")
http_case("source_http_page", paging="page", method="POST")
http_case("source_http_cursor", paging="cursor")

DOCUMENT = {
    "openapi": "3.0.1",
    "servers": [{"url": "http://service"}],
    "paths": {"/{what}": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Customer"}}}}}}}}},
    "components": {"schemas": {"Customer": {"type": "object", "properties": {"c_custkey": {"type": "integer"}, "c_name": {"type": "string"}, "c_acctbal": {"type": "number"}}}}},
}


@case("source_openapi", "select c_custkey, c_name, c_acctbal from customer where c_acctbal < 0")
def source_openapi(spark: SparkSession, d: str) -> DataFrame:
    """Columns and address come from the service's description."""
    url = openapi_request(DOCUMENT, "/{what}", parameters={"what": "customers"}).url
    rows = http_rows(spark, HttpPages(url, data_path="data", size=PAGE, paging="offset"), openapi_schema(DOCUMENT, "/{what}"), partial(answer, pages_folder(spark, d)))
    return Query.over(rows).less_than("c_acctbal", 0).out().to_df().select("c_custkey", "c_name", "c_acctbal")


class FileStore:
    """A stand-in for a key-value store: the values of a file, also as a sorted set by account balance."""

    def __init__(self, path: str):
        self.rows = json.loads(Path(path).read_text())

    def scan_iter(self, match: str):
        return (f"customer:{i}" for i in range(len(self.rows))) if match == "customer:*" else iter(())

    def mget(self, keys: list[str]) -> list[str]:
        return [json.dumps(self.rows[int(k.split(":")[1])]) for k in keys]

    def between(self, low: str, high: str) -> list[dict]:
        edge = lambda s: float(s.lstrip("("))
        kept = [r for r in self.rows if (r["c_acctbal"] > edge(low) or r["c_acctbal"] == edge(low) and low[0] != "(") and (r["c_acctbal"] < edge(high) or r["c_acctbal"] == edge(high) and high[0] != "(")]
        return sorted(kept, key=lambda r: (r["c_acctbal"], json.dumps(r)))

    def zrangebyscore(self, key: str, low: str, high: str, start: int, num: int) -> list[str]:
        return [json.dumps(r) for r in self.between(low, high)[start : start + num]]

    def zrevrangebyscore(self, key: str, high: str, low: str, start: int, num: int) -> list[str]:
        return [json.dumps(r) for r in self.between(low, high)[::-1][start : start + num]]


def store(spark: SparkSession, d: str):
    return partial(FileStore, local_path(array_file(spark, d)))


@case("source_redis_keys", "select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING'")
def source_redis_keys(spark: SparkSession, d: str) -> DataFrame:
    return Query.over(redis_rows(spark, store(spark, d), CUSTOMER, match="customer:*")).equals("c_mktsegment", "BUILDING").out().to_df().select("c_custkey", "c_acctbal")


@case("source_redis_sorted", "select c_custkey from customer where c_acctbal > 1000 and c_acctbal <= 4000 and c_nationkey <> 3")
def source_redis_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = redis_sorted_rows(spark, store(spark, d), "balances", "c_acctbal", CUSTOMER)
    return Query.over(rows).greater_than("c_acctbal", 1000).less_than_or_equal("c_acctbal", 4000).not_equals("c_nationkey", 3).out().to_df().select("c_custkey")


@case("source_redis_top", "select c_custkey, c_acctbal from customer where c_acctbal < 9000 order by c_acctbal desc, c_custkey limit 25 offset 5")
def source_redis_top(spark: SparkSession, d: str) -> DataFrame:
    """The range, the order and the limit reach the store."""
    data = Dataset(redis_sorted_rows(spark, store(spark, d), "balances", "c_acctbal", CUSTOMER), KEYS["customer"])
    return Query.over(data).less_than("c_acctbal", 9000).out().order_by("c_acctbal", "desc").offset(5).limit(25).to_df().select("c_custkey", "c_acctbal")


class Orders:
    """A source of one's own, which answers for limits by price."""

    def __init__(self, spark: SparkSession, d: str):
        self.rows = parquet(spark, f"{d}/orders.parquet")

    def materialize(self) -> DataFrame:
        return self.rows

    def pushdown(self, asked: Asked) -> DataFrame | None:
        if asked.where or [(o.path, o.descending) for o in asked.orders] != [("o_totalprice", True)]:
            return None
        return self.rows.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(asked.limit)


@case("source_custom", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 30 offset 3")
def source_custom(spark: SparkSession, d: str) -> DataFrame:
    return Query.over(Dataset.of_source(Orders(spark, d), KEYS["orders"])).out().order_by("o_totalprice", "desc").offset(3).limit(30).to_df().select("o_orderkey")


@case("source_rows", "select s_suppkey, s_name from supplier where s_suppkey <= 5")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows from the program, loaded into an empty dataset of a schema, cleared and loaded again."""
    suppliers = parquet(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    data = Dataset.from_schema(spark, suppliers.schema, ("s_suppkey",)).load([tuple(r) for r in suppliers.collect()]).clear().load_from(suppliers)
    return Query.over(data).less_than_or_equal("s_suppkey", 5).out().to_df()


# What else has SQL.


@case("path_exists_nullable", "select event_id from events where json_exists(props, '$.k')")
def path_exists_nullable(spark: SparkSession, d: str) -> DataFrame:
    df = parquet(spark, f"{d}/events.parquet").select("event_id", F.parse_json("props").alias("props"))
    return Query.over(df).path_exists_nullable("props.k").out().to_df().select("event_id")


@case("then_by_date", "select o_orderkey from orders order by o_orderstatus, o_orderdate desc, o_orderkey limit 70")
def then_by_date(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").out().order_by("o_orderstatus").then_by_date("o_orderdate", "desc").limit(70).to_df().select("o_orderkey")


@case("fuzzy_last_wins", fuzzy_sql("part", "p_partkey", "p_name", "an", "select id as p_partkey from scored where score > 0"))
def fuzzy_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of several searches the last one counts."""
    return query(spark, d, "part").configure_fuzzy(["p_name"]).search("zzz").search("an").out().to_df().select("p_partkey")


@case("fuzzy_empty_query", "select p_partkey from part")
def fuzzy_empty_query(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "part").configure_fuzzy(["p_name"]).search("").out().to_df().select("p_partkey")


@case("fuzzy_top", fuzzy_sql("part", "p_partkey", "p_name", "re", "select id as p_partkey, cast(score as double) as _score from scored where score > 0 order by score desc, id limit 50"))
def fuzzy_top(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "part").configure_fuzzy(["p_name"]).search("re").out().limit(50).result_with_metadata().select("p_partkey", "_score")


@case("search_not_configured", "select 2 as refused")
def search_not_configured(spark: SparkSession, d: str) -> DataFrame:
    """What needs a configuration is refused without one."""
    refused = 0
    for ask in (lambda q: q.search("a"), lambda q: q.tags(has=["x"])):
        try:
            ask(query(spark, d, "part"))
        except ValueError:
            refused += 1
    return spark.createDataFrame([(refused,)], "refused int")


@case("tags_last_wins", "select event_id from events where event_type = 'purchase'")
def tags_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return tagged(query(spark, d, "events")).tags(has=["soft"]).tags(has=["money"]).out().to_df().select("event_id")


@case("plan_identity", "select true as same, false as other")
def plan_identity(spark: SparkSession, d: str) -> DataFrame:
    """Equal predicates have equal ids, unequal ones have not."""
    a, b, c = (QueryChain.from_(None, lambda q, v=v: q.equals("o_orderstatus", v)) for v in ("F", "F", "O"))
    return spark.createDataFrame([(a.plan_id == b.plan_id, a.plan_id == c.plan_id)], "same boolean, other boolean")


@case("run_report", "select count(*) as n, 1 as plans, 1 as spans from orders where o_orderstatus = 'P'")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """What a run records of itself: its rows, its plan, its span."""
    telemetry.clear()
    telemetry.enable()
    try:
        query(spark, d, "orders").equals("o_orderstatus", "P").out().write(format="noop")
        report = telemetry.run_report()
    finally:
        telemetry.enable(False)
    return spark.createDataFrame([(report["rows"][0], len(report["plans"]), report["spans"]["result"]["count"])], "n long, plans int, spans int")


@case("contradiction_report", "select 1 as contradictions, 2 as dropped")
def contradiction_report(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "orders").equals("o_orderstatus", "F").equals("o_orderstatus", "F").not_in("o_orderstatus", []).greater_than("o_totalprice", 5).less_than("o_totalprice", 2)
    found = q.plan()[1]
    return spark.createDataFrame([(len(found.contradictions), len(found.dropped))], "contradictions int, dropped int")


# Dates don't depend on the session's zone.


def elsewhere(spark: SparkSession, zone: str) -> SparkSession:
    """A session of its own beside the given one."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    return other


def days(spark: SparkSession, d: str) -> Dataset:
    day = F.col("o_orderdate").cast("string")
    rows = parquet(spark, f"{d}/orders.parquet").select("o_orderkey", F.substring(day, 1, 10).alias("text"), F.to_date(F.substring(day, 1, 10)).alias("day"), F.col("o_orderdate").alias("time"))
    return Dataset(rows, ("o_orderkey",))


def zone_case(name: str, build, where: str) -> None:
    case(name, f"select o_orderkey from orders where {where}")(lambda spark, d: build(Query.over(days(elsewhere(spark, "America/New_York"), d))).out().to_df().select("o_orderkey"))


zone_case("date_elsewhere_text", lambda q: q.date_equals("text", "1996-03-01"), "cast(o_orderdate as date) = date '1996-03-01'")
zone_case("date_elsewhere_day", lambda q: q.date_between("day", "1996-03-01", "1996-03-05T12:00:00Z").not_equals("day", dt.date(1996, 3, 2)), "cast(o_orderdate as date) between date '1996-03-01' and date '1996-03-05' and cast(o_orderdate as date) <> date '1996-03-02'")
zone_case("date_elsewhere_time", lambda q: q.date_after("time", "2001-01-01T00:00:00Z").date_before_or_equal("text", "2001-02-01"), "o_orderdate > timestamp '2001-01-01' and cast(o_orderdate as date) <= date '2001-02-01'")


@case("group_date_elsewhere", "select cast(epoch_ms(cast(o_orderdate as date)) as bigint) as _key, count(*) as _count from orders group by 1")
def group_date_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    return Query.over(days(elsewhere(spark, "Asia/Tokyo"), d)).out().group_by("text", date=True).counts()


@case("order_date_elsewhere", "select o_orderkey from orders order by cast(o_orderdate as date) desc, o_orderkey limit 90")
def order_date_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    return Query.over(days(elsewhere(spark, "America/New_York"), d)).out().order_by_date("text", "desc").limit(90).to_df().select("o_orderkey")
