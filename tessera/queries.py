"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ChainRegistry, Dataset, Query, QueryChain
from .plans import telemetry
from .sources import parquet
from .sources.scratch import written

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

KEYS = {"orders": ("o_orderkey",), "customer": ("c_custkey",), "part": ("p_partkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "supplier": ("s_suppkey",), "nation": ("n_nationkey",)}


def query(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return Query.over(Dataset(parquet(spark, f"{sf_dir}/{name}.parquet"), KEYS[name]))


def case(name: str, sql: str) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def simple(name: str, table: str, columns: str, build: Callable[[Query], Query], where: str) -> None:
    """A query that keeps some rows of a table."""
    picked = [c.strip() for c in columns.split(",")]
    case(name, f"select {columns} from {table} where {where}")(lambda spark, d: build(query(spark, d, table)).out().to_df().select(*picked))


ORDERS = "o_orderkey, o_orderstatus, o_totalprice"
simple("eq", "orders", ORDERS, lambda q: q.equals("o_orderstatus", "F"), "o_orderstatus = 'F'")
simple("eq_other_class", "orders", ORDERS, lambda q: q.equals("o_orderstatus", 1), "false")
simple("eq_other_class_same_value", "part", "p_partkey, p_size", lambda q: q.equals("p_size", 1).equals("p_size", True), "false")
simple("ne_other_class_same_value", "part", "p_partkey, p_size", lambda q: q.equals("p_size", 1).not_equals("p_size", True), "p_size = 1")
simple("ne", "orders", ORDERS, lambda q: q.not_equals("o_orderstatus", "F"), "o_orderstatus is distinct from 'F'")
simple("gt", "orders", ORDERS, lambda q: q.greater_than("o_totalprice", 250000), "o_totalprice > 250000")
simple("gte", "lineitem", "l_orderkey, l_linenumber, l_quantity", lambda q: q.greater_than_or_equal("l_quantity", 45), "l_quantity >= 45")
simple("lt", "part", "p_partkey, p_size", lambda q: q.less_than("p_size", 10), "p_size < 10")
simple("lte", "part", "p_partkey, p_size", lambda q: q.less_than_or_equal("p_size", 10), "p_size <= 10")
simple("between", "orders", ORDERS, lambda q: q.between("o_totalprice", 100000, 150000), "o_totalprice between 100000 and 150000")
simple("in_list", "orders", ORDERS, lambda q: q.in_("o_orderstatus", ["F", "P"]), "o_orderstatus in ('F', 'P')")
simple("not_in", "orders", ORDERS, lambda q: q.not_in("o_orderstatus", ["F", "P"]), "o_orderstatus not in ('F', 'P') or o_orderstatus is null")
simple("in_empty", "orders", ORDERS, lambda q: q.in_("o_orderstatus", []), "false")
simple("not_in_empty", "orders", ORDERS, lambda q: q.not_in("o_orderstatus", []), "true")
simple("contains", "part", "p_partkey, p_name", lambda q: q.contains("p_name", "a"), "contains(p_name, 'a')")
simple("contains_ci", "part", "p_partkey, p_name", lambda q: q.contains("p_name", "RE", ignore_case=True), "contains(lower(p_name), 're')")
simple("starts_with", "part", "p_partkey, p_type", lambda q: q.starts_with("p_type", "S"), "starts_with(p_type, 'S')")
simple("ends_with", "part", "p_partkey, p_brand", lambda q: q.ends_with("p_brand", "3"), "suffix(p_brand, '3')")
simple("matches", "part", "p_partkey, p_brand", lambda q: q.matches("p_brand", r"^b[a-z]+#[1-3]\d$", "i"), r"regexp_matches(p_brand, '^b[a-z]+#[1-3]\d$', 'i')")
simple("matches_documents", "documents", "doc_id, n_chars", lambda q: q.matches("text", r'token\s*=\s*"[0-9a-f]{8}'), r"""regexp_matches(text, 'token\s*=\s*"[0-9a-f]{8}')""")
simple("date_equals", "orders", "o_orderkey, o_orderdate", lambda q: q.date_equals("o_orderdate", "1996-03-01"), "o_orderdate = timestamp '1996-03-01'")
simple("date_after", "orders", "o_orderkey, o_orderdate", lambda q: q.date_after("o_orderdate", "2000-01-01"), "o_orderdate > timestamp '2000-01-01'")
simple("date_after_or_equal", "orders", "o_orderkey, o_orderdate", lambda q: q.date_after_or_equal("o_orderdate", "2000-01-01"), "o_orderdate >= timestamp '2000-01-01'")
simple("date_before", "orders", "o_orderkey, o_orderdate", lambda q: q.date_before("o_orderdate", "1996-01-01T00:00:00Z"), "o_orderdate < timestamp '1996-01-01'")
simple("date_before_or_equal", "orders", "o_orderkey, o_orderdate", lambda q: q.date_before_or_equal("o_orderdate", 820454400000), "o_orderdate <= timestamp '1996-01-01'")
simple("date_between", "orders", "o_orderkey, o_orderdate", lambda q: q.date_between("o_orderdate", "1996-02-01", "1996-02-31"), "o_orderdate between timestamp '1996-02-01' and timestamp '1996-03-02'")
simple("date_bad_literal", "orders", "o_orderkey, o_orderdate", lambda q: q.date_after("o_orderdate", "soon"), "false")
simple("exclusive_range", "part", "p_partkey, p_size", lambda q: q.greater_than("p_size", 5).less_than("p_size", 10), "p_size > 5 and p_size < 10")
simple("in_then_eq", "orders", ORDERS, lambda q: q.in_("o_orderstatus", ["O", "P"]).equals("o_orderstatus", "F"), "false")
simple("false_group", "orders", ORDERS, lambda q: q.not_(lambda g: g.equals("o_orderstatus", "F").equals("o_orderstatus", "O")), "true")
simple("and_group", "orders", ORDERS, lambda q: q.equals("o_orderstatus", "F").and_(lambda g: g.greater_than("o_totalprice", 1e5).less_than("o_totalprice", 2e5)), "o_orderstatus = 'F' and o_totalprice > 1e5 and o_totalprice < 2e5")
simple("or_group", "orders", ORDERS, lambda q: q.equals("o_orderstatus", "P").or_(lambda g: g.greater_than("o_totalprice", 3e5).equals("o_orderstatus", "F")), "o_orderstatus = 'P' or (o_totalprice > 3e5 and o_orderstatus = 'F')")
simple("not_group", "orders", ORDERS, lambda q: q.not_(lambda g: g.equals("o_orderstatus", "F").greater_than("o_totalprice", 1e5)), "not (o_orderstatus = 'F' and o_totalprice > 1e5)")
simple("custom", "orders", ORDERS, lambda q: q.custom(lambda c: c("o_totalprice") > 200 * c("o_custkey")), "o_totalprice > 200 * o_custkey")
simple("custom_python", "part", "p_partkey, p_size", lambda q: q.custom(lambda r: r["p_size"] > len(r["p_name"]) and r["p_brand"].endswith("2"), python=True), "p_size > length(p_name) and suffix(p_brand, '2')")


# Values that may be missing.


def sparse(spark: SparkSession, d: str) -> Query:
    df = parquet(spark, f"{d}/events.parquet").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("event_type") == "click", float("nan")).when(F.col("event_type") != "error", F.col("value")).alias("number"))
    return Query.over(Dataset(df, ("event_id",)))


SPARSE = "(select event_id, nullif(event_type, 'view') as kind, case when event_type = 'click' then 'NaN'::double when event_type <> 'error' then value end as number from events)"


def sparse_case(name: str, build: Callable[[Query], Query], where: str) -> None:
    case(name, f"select event_id from {SPARSE} where {where}")(lambda spark, d: build(sparse(spark, d)).out().to_df().select("event_id"))


sparse_case("is_null", lambda q: q.is_null("kind"), "kind is null")
sparse_case("not_null", lambda q: q.value_not_null("kind"), "kind is not null")
sparse_case("ne_keeps_null", lambda q: q.not_equals("kind", "click"), "kind is distinct from 'click'")
sparse_case("not_in_keeps_null", lambda q: q.not_in("kind", ["click", "error"]), "kind is null or kind not in ('click', 'error')")
sparse_case("not_keeps_null", lambda q: q.not_(lambda g: g.starts_with("kind", "c")), "not coalesce(starts_with(kind, 'c'), false)")
sparse_case("nan_compares_with_nothing", lambda q: q.greater_than("number", 10), "number > 10 and not isnan(number)")
sparse_case("nan_in_negation", lambda q: q.not_(lambda g: g.greater_than("number", 10)), "not coalesce(number > 10 and not isnan(number), false)")
sparse_case("equals_null", lambda q: q.equals("number", None), "number is null")


@case("string_dates", "select event_id from (select event_id, case event_type when 'signup' then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 'view' then strftime(ts, '%Y-%m-%d') when 'error' then 'not-a-date' else strftime(ts, '%Y/%m/%d') end as day from events) where regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}') and try_cast(replace(day, 'Z', '') as timestamp) >= (select min(date_trunc('day', ts)) + interval 3 day from events)")
def string_dates(spark: SparkSession, d: str) -> DataFrame:
    events = parquet(spark, f"{d}/events.parquet")
    kind, ts = F.col("event_type"), F.col("ts")
    day = F.when(kind == "signup", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == "view", F.date_format(ts, "yyyy-MM-dd")).when(kind == "error", "not-a-date").otherwise(F.date_format(ts, "yyyy/MM/dd"))
    start = events.select((F.min(F.date_trunc("day", "ts")) + F.expr("interval 3 day")).alias("s")).first()["s"]
    return Query.over(Dataset(events.select("event_id", day.alias("day")), ("event_id",))).date_after_or_equal("day", start).out().to_df().select("event_id")


@case("path_exists", "select event_id from events where json_exists(props, '$.k')")
def path_exists(spark: SparkSession, d: str) -> DataFrame:
    df = parquet(spark, f"{d}/events.parquet").select("event_id", F.parse_json("props").alias("props"))
    return Query.over(df).path_exists("props.k").not_(lambda g: g.path_exists("props.other")).out().to_df().select("event_id")


@case("variant_number", "select event_id from events where cast(props->>'$.k' as double) > 50")
def variant_number(spark: SparkSession, d: str) -> DataFrame:
    df = parquet(spark, f"{d}/events.parquet").select("event_id", F.parse_json("props").alias("props"))
    return Query.over(df).greater_than("props.k", 50).out().to_df().select("event_id")


# Nested rows: an order with its lines, and its customer's nation.


def with_lines(spark: SparkSession, d: str) -> Query:
    """Orders with their lines, by number. The nested table is written once for a session; queries read that."""

    def build() -> DataFrame:
        line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("shipped"))
        lines = parquet(spark, f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
        orders = parquet(spark, f"{d}/orders.parquet")
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "o_totalprice", "lines")

    return Query.over(Dataset(parquet(spark, written(spark, f"{d}:orders with lines", lambda path: build().write.parquet(path))), ("o_orderkey",)))


def with_owners(spark: SparkSession, d: str) -> Query:
    """Orders with their customer and nation as a struct."""
    people = parquet(spark, f"{d}/customer.parquet").join(parquet(spark, f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    owners = people.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("name")).alias("nation")).alias("owner"))
    orders = parquet(spark, f"{d}/orders.parquet").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
    return Query.over(Dataset(orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "owner"), ("o_orderkey",)))


def nested_case(name: str, build: Callable[[Query], Query], where: str, rows: Callable[[SparkSession, str], Query] = with_lines) -> None:
    case(name, f"select o_orderkey from orders o where {where}")(lambda spark, d: build(rows(spark, d)).out().to_df().select("o_orderkey"))


LINE = "exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and {})"
nested_case("path_through_array", lambda q: q.equals("lines.flag", "R"), LINE.format("l_returnflag = 'R'"))
nested_case("array_not_equals", lambda q: q.not_equals("lines.flag", "R"), "not " + LINE.format("l_returnflag = 'R'"))
nested_case("array_two_elements", lambda q: q.equals("lines.flag", "R").equals("lines.flag", "N"), LINE.format("l_returnflag = 'R'") + " and " + LINE.format("l_returnflag = 'N'"))
nested_case("array_date", lambda q: q.date_after("lines.shipped", "2001-01-01"), LINE.format("l_shipdate > timestamp '2001-01-01'"))
nested_case("array_some", lambda q: q.array_some("lines.quantity", lambda x: x > 48), LINE.format("l_quantity > 48"))
nested_case("array_every", lambda q: q.array_every("lines.quantity", lambda x: x > 10), LINE.format("true") + " and not " + LINE.format("l_quantity <= 10"))
nested_case("array_none", lambda q: q.array_none("lines.quantity", lambda x: x > 10), "not " + LINE.format("l_quantity > 10"))
nested_case("nested", lambda q: q.nested("lines", lambda e: e.equals("flag", "R").greater_than("quantity", 40)), LINE.format("l_returnflag = 'R' and l_quantity > 40"))
nested_case("nested_or", lambda q: q.nested("lines", lambda e: e.equals("flag", "R").or_(lambda g: g.greater_than("quantity", 45).date_before("shipped", "1996-01-01"))), LINE.format("(l_returnflag = 'R' or (l_quantity > 45 and l_shipdate < timestamp '1996-01-01'))"))
nested_case("struct_path", lambda q: q.starts_with("owner.nation.name", "NATION_1").greater_than("o_totalprice", 1e5), "o_totalprice > 1e5 and exists (select 1 from customer join nation on c_nationkey = n_nationkey where c_custkey = o_custkey and starts_with(n_name, 'NATION_1'))", with_owners)


# Orders, windows, pages.


@case("flagship", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice > 100000 order by o_totalprice desc, o_orderkey limit 100")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "orders").in_("o_orderstatus", ["F", "O"]).greater_than("o_totalprice", 100000)
    return q.out().order_by("o_totalprice", "desc").limit(100).to_df().select("o_orderkey", "o_orderstatus", "o_totalprice")


@case("order_nulls_last", f"select event_id, number from {SPARSE} order by case when isnan(number) then null else number end desc nulls last, event_id limit 500")
def order_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d).out().order_by("number", "desc").limit(500).to_df().select("event_id", "number")


@case("order_nulls_first", f"select event_id, kind from {SPARSE} order by kind asc nulls first, event_id limit 2500")
def order_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d).out().order_by("kind", nulls="first").limit(2500).to_df().select("event_id", "kind")


@case("order_by_date", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50")
def order_by_date(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").out().order_by_date("o_orderdate", "desc").limit(50).to_df().select("o_orderkey", "o_orderdate")


@case("builder_order", "select o_orderkey from orders order by o_totalprice, o_orderkey limit 20")
def builder_order(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").order_by("o_totalprice").out().limit(20).to_df().select("o_orderkey")


@case("then_by", "select p_partkey, p_brand, p_size from part order by p_brand, p_size desc, p_partkey limit 120 offset 30")
def then_by(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "part").out().order_by("p_brand").then_by("p_size", "desc").offset(30).limit(120).to_df().select("p_partkey", "p_brand", "p_size")


@case("offset_only", "select p_partkey from part order by p_retailprice, p_partkey offset 100")
def offset_only(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "part").out().order_by("p_retailprice").offset(100).to_df().select("p_partkey")


@case("limit_without_order", "select o_orderkey from orders order by o_orderkey limit 15")
def limit_without_order(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").out().limit(15.9).to_df().select("o_orderkey")


@case("page", "select o_orderkey from orders order by o_totalprice, o_orderkey limit 25 offset 50")
def page(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").out().order_by("o_totalprice").page(3, 25).to_df().select("o_orderkey")


@case("first", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 1")
def first(spark: SparkSession, d: str) -> DataFrame:
    row = query(spark, d, "orders").equals("o_orderstatus", "F").out().order_by("o_totalprice", "desc").first_or_throw()
    return spark.createDataFrame([(row["o_orderkey"], row["o_totalprice"])], "o_orderkey long, o_totalprice double")


@case("paginate", "select o_orderkey, (select count(*) from orders where o_orderstatus = 'P') as total from (select o_orderkey from orders where o_orderstatus = 'P' order by o_totalprice, o_orderkey limit 10 offset 10)")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    pages = query(spark, d, "orders").equals("o_orderstatus", "P").out().order_by("o_totalprice").paginate(10)
    pages.next()
    return pages.data_frame().select("o_orderkey", F.lit(pages.total).cast("long").alias("total"))


@case("order_by_array", "select o_orderkey from (select o_orderkey, (select min(l_quantity) from lineitem where l_orderkey = o_orderkey) as q from orders) order by q desc nulls last, o_orderkey limit 40")
def order_by_array(spark: SparkSession, d: str) -> DataFrame:
    """The first of an array's values is the key; here they are sorted."""
    df = with_lines(spark, d).data.df
    quantities = df.withColumn("quantities", F.array_sort(F.transform("lines", lambda x: x["quantity"])))
    return Query.over(Dataset(quantities, ("o_orderkey",))).out().order_by("quantities", "desc").limit(40).to_df().select("o_orderkey")


# Groups.


@case("group_scalar", "select event_type as _key, count(*) as _count from events group by event_type")
def group_scalar(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "events").out().group_by("event_type").counts()


@case("group_array", "select l_returnflag as _key, count(*) as _count from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' group by 1")
def group_array(spark: SparkSession, d: str) -> DataFrame:
    return with_lines(spark, d).equals("o_orderstatus", "F").out().group_by("lines.flag").counts()


@case("group_date", "select cast(epoch_ms(o_orderdate) as bigint) as _key, count(*) as _count from orders group by 1")
def group_date(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").out().group_by("o_orderdate", date=True).counts()


@case("group_rows", "select o_orderstatus as _key, o_orderkey from orders")
def group_rows(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "orders").out().group_by("o_orderstatus").rows().select("_key", "o_orderkey")


@case("group_window", "select o_orderstatus as _key, o_orderkey from (select * from orders order by o_totalprice desc, o_orderkey limit 200)")
def group_window(spark: SparkSession, d: str) -> DataFrame:
    """Groups respect a window."""
    return query(spark, d, "orders").out().order_by("o_totalprice", "desc").limit(200).group_by("o_orderstatus").rows().select("_key", "o_orderkey")


@case("group_collected", "select p_brand as _key, count(*) as n, min(p_partkey) as first_key, max(p_partkey) as last_key from part group by 1")
def group_collected(spark: SparkSession, d: str) -> DataFrame:
    got = query(spark, d, "part").out().group_by("p_brand").collected()
    return got.select("_key", F.size("_rows").cast("long").alias("n"), F.get("_rows", F.lit(0))["p_partkey"].alias("first_key"), F.element_at("_rows", -1)["p_partkey"].alias("last_key"))


@case("group_collected_ordered", "select p_brand as _key, count(*) as n, arg_max(p_partkey, (p_retailprice, -p_partkey)) as first_key, arg_min(p_partkey, (p_retailprice, -p_partkey)) as last_key from part group by 1")
def group_collected_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a group come in the order asked for."""
    got = query(spark, d, "part").out().order_by("p_retailprice", "desc").group_by("p_brand").collected()
    return got.select("_key", F.size("_rows").cast("long").alias("n"), F.get("_rows", F.lit(0))["p_partkey"].alias("first_key"), F.element_at("_rows", -1)["p_partkey"].alias("last_key"))


# Search.

#: The score by recursion over the characters of the lower-cased text.
FUZZY_SQL = """
with recursive t as (select {key} as id, lower({column}) as s from {table}),
walk as (
  select id, s, 0 as i, 0 as used, -1 as last, 0 as score from t
  union all
  select id, s, i + 1,
    case when used < {n} and s[i + 1] = '{q}'[used + 1] then used + 1 else used end,
    case when used < {n} and s[i + 1] = '{q}'[used + 1] then i else last end,
    case when used < {n} and s[i + 1] = '{q}'[used + 1] then score + 10
      + case when i = 0 or s[i] in ('-', '_', ' ', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') then 6 else 0 end
      + case when last = i - 1 then 4 else 0 end else score end
  from walk where i < length(s)
),
scored as (select id, case when used = {n} then score else 0 end as score from walk where i = length(s))
"""


def fuzzy_sql(table: str, key: str, column: str, q: str, rest: str) -> str:
    return FUZZY_SQL.format(table=table, key=key, column=column, q=q, n=len(q)) + rest


@case("fuzzy_score", fuzzy_sql("part", "p_partkey", "p_name", "ae", "select id as p_partkey, cast(score as double) as _score from scored where score > 0"))
def fuzzy_score(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "part").configure_fuzzy(["p_name"]).search("AE")
    return q.out().result_with_metadata().select("p_partkey", "_score")


@case("fuzzy_min_score", fuzzy_sql("customer", "c_custkey", "c_name", "cu1", "select id as c_custkey from scored where score >= 40"))
def fuzzy_min_score(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "customer").configure_fuzzy([{"path": "c_name"}], min_score=40).search({"fuzzy": {"query": "cu1"}})
    return q.out().to_df().select("c_custkey")


@case("fuzzy_weights", fuzzy_sql("part", "p_partkey", "p_name", "a", "select id as p_partkey, cast(2.0 * score as double) as _score from scored join part on id = p_partkey where score > 0"))
def fuzzy_weights(spark: SparkSession, d: str) -> DataFrame:
    """The second field never outweighs the first."""
    q = query(spark, d, "part").configure_fuzzy([{"path": "p_name", "weight": 2}, {"path": "p_name", "weight": 0.5}]).search("a")
    return q.out().result_with_metadata().select("p_partkey", "_score")


def tagged(q: Query) -> Query:
    rules = [
        {"tag": "money", "path": "event_type", "equals": "purchase"},
        {"tag": "bad", "path": "event_type", "contains": "ERR"},
        {"tag": "high", "path": "value", "in_": (1.0, 2.0)},
        {"tag": "soft", "path": "event_type", "starts_with": "vi"},
        {"tag": "soft", "path": "event_type", "ends_with": "CK"},
        {"tag": "up", "path": "event_type", "matches": "^sign.p$"},
        {"tag": "unknown", "path": "event_type", "equals": "view"},
    ]
    return q.configure_tagger(["money", "bad", "high", "soft", "up"], rules)


MASK_SQL = "(select event_id, case when event_type = 'purchase' then 1 else 0 end + case when contains(event_type, 'err') then 2 else 0 end + case when value in (1.0, 2.0) then 4 else 0 end + case when starts_with(event_type, 'vi') or suffix(event_type, 'ck') then 8 else 0 end + case when regexp_matches(event_type, '^sign.p$') then 16 else 0 end as m from events)"


@case("tagger_mask", f"select event_id, cast(m as bigint) as _tag_mask from {MASK_SQL}")
def tagger_mask(spark: SparkSession, d: str) -> DataFrame:
    return tagged(query(spark, d, "events")).tags().out().result_with_metadata().select("event_id", "_tag_mask")


@case("tags_has", f"select event_id from {MASK_SQL} where m & 8 = 8")
def tags_has(spark: SparkSession, d: str) -> DataFrame:
    return tagged(query(spark, d, "events")).tags(has=["soft"]).out().to_df().select("event_id")


@case("tags_has_any", f"select event_id from {MASK_SQL} where m & 3 <> 0")
def tags_has_any(spark: SparkSession, d: str) -> DataFrame:
    return tagged(query(spark, d, "events")).search(["money", "bad", "nobody"]).out().to_df().select("event_id")


@case("tags_not", f"select event_id from {MASK_SQL} where m & 10 = 0")
def tags_not(spark: SparkSession, d: str) -> DataFrame:
    return tagged(query(spark, d, "events")).tags(not_=["bad"], not_any=["soft"]).out().to_df().select("event_id")


@case("search_combined", fuzzy_sql("part", "p_partkey", "p_name", "an", "select p_partkey, cast(score as double) as _score, cast(1 as bigint) as _tag_mask from scored join part on id = p_partkey where score > 0 and p_size > 20 and starts_with(lower(p_brand), 'brand#1')"))
def search_combined(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "part").greater_than("p_size", 20).configure_fuzzy(["p_name"]).configure_tagger(["one"], [{"tag": "one", "path": "p_brand", "starts_with": "Brand#1"}])
    return q.search({"fuzzy": "an", "tags": {"has": ["one"]}}).out().result_with_metadata().select("p_partkey", "_score", "_tag_mask")


# Chains and reports.


@case("chain_reuse", "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 200000 and o_orderpriority like '1%'")
def chain_reuse(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "orders")
    registry = ChainRegistry()
    registry.register("large", QueryChain.from_(q.data.schema, lambda b: b.equals("o_orderstatus", "F").greater_than("o_totalprice", 200000)))
    return q.use(registry.get("large")).starts_with("o_orderpriority", "1").out().to_df().select("o_orderkey")


@case("chain_algebra", "select o_orderkey from orders where not (o_orderstatus = 'F' or o_totalprice > 200000)")
def chain_algebra(spark: SparkSession, d: str) -> DataFrame:
    q = query(spark, d, "orders")
    a, b = (QueryChain.from_(q.data.schema, f) for f in (lambda b: b.equals("o_orderstatus", "F"), lambda b: b.greater_than("o_totalprice", 200000)))
    return a.or_(b).not_().out(q.data).to_df().select("o_orderkey")


@case("observed_counts", "select count(*) as n, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_totalprice > 200000) as large from orders")
def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    df, seen = telemetry.observed(query(spark, d, "orders").equals("o_orderstatus", "F").greater_than("o_totalprice", 200000))
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["0:eq(o_orderstatus)"], got["1:gt(o_totalprice)"])], "n long, f long, large long")
