"""The small fixtures: four rows with nested values, and a few rows for orders."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera import ChainRegistry, Dataset, NoRowError, PathError, Query, QueryChain, create_chain, telemetry

SCHEMA = """active boolean, created string, flags array<string>, HandledBy struct<SalesRep:string>, id long, label string,
Logs array<struct<message:string,tags:array<string>,type:string,when:string>>, meta struct<owner:struct<name:string,nickname:string>>,
metrics struct<maybe:double,values:array<double>>, misc struct<code:string,nested:struct<value:string>>, name string, note string, score double"""

ROWS = [
    (True, "2024-01-01", ["red", "blue"], ("NHR",), 1, "2024-01-01", [("over", ["x"], "CREDIT_MAX_EXCEEDED", "2024-01-03T00:00:00.000Z")], (("Alice", None),), (0.0, [1.0, 2.0, 3.0]), ("X1", (None,)), "Alpha", None, 10.0),
    (False, "2024-01-02T00:00:00.000Z", ["green"], (None,), 2, "release", [(None, [], "OTHER", "2024-01-04")], (("Bob", "B"),), (None, [5.0]), (None, None), "Beta", "ok", 20.0),
    (True, "not-a-date", [], ("THS",), 3, "not-a-date", [], (("Cara", None),), (None, []), None, "Gamma", None, 5.0),
    (True, "2024-01-01T00:00:00.000Z", ["red"], ("NHR",), 4, "2024-01-01", [("dup", ["y"], "CREDIT_MAX_EXCEEDED", "2024-01-03T00:00:00.000Z")], (("Dee", None),), (None, [10.0]), (None, ("ok",)), "Delta", None, 10.0),
]


@pytest.fixture(scope="module")
def q(spark):
    return Query.over(Dataset.from_rows(spark, ROWS, SCHEMA, ("id",)))


def ids(query) -> list[int]:
    out = query if hasattr(query, "to_df") else query.out()
    return [r["id"] for r in out.to_df().collect()]


CASES = {
    "equals_array": (lambda q: q.equals("flags", "green"), [2]),
    "not_equals_array": (lambda q: q.not_equals("flags", "red"), [2, 3]),
    "not_equals_null": (lambda q: q.not_equals("note", None), [2]),
    "date_equals": (lambda q: q.date_equals("created", 1704067200000), [1, 4]),
    "date_bad_bound": (lambda q: q.date_between("created", "2024-01-01", "never"), []),
    "between": (lambda q: q.between("score", 6, 20), [1, 2, 4]),
    "or": (lambda q: q.equals("id", 1).or_(lambda g: g.equals("id", 2)), [1, 2]),
    "or_empty_group": (lambda q: q.equals("id", 1).or_(lambda g: g), [1]),
    "or_empty_left": (lambda q: q.or_(lambda g: g.equals("id", 2)), [2]),
    "not_empty_group": (lambda q: q.not_(lambda g: g), []),
    "is_null": (lambda q: q.is_null("note"), [1, 3, 4]),
    "not_null": (lambda q: q.value_not_null("note"), [2]),
    "nested_null_parent": (lambda q: q.is_null("misc.nested.value"), [1]),
    "path_exists_parent": (lambda q: q.path_exists("misc.nested.value"), [1, 4]),
    "path_exists_unknown": (lambda q: q.path_exists("no.where"), []),
    "path_exists_array": (lambda q: q.path_exists("Logs.tags"), [1, 2, 4]),
    "every_length": (lambda q: q.array_every("flags", lambda x: F.length(x) >= 4), [2]),
    "every_true": (lambda q: q.array_every("flags", lambda x: F.lit(True)), [1, 2, 4]),
    "none": (lambda q: q.array_none("flags", lambda x: x == "red"), [2, 3]),
    "some_scalar": (lambda q: q.array_some("score", lambda x: x > 15), [2]),
    "nested": (lambda q: q.nested("Logs", lambda e: e.equals("type", "CREDIT_MAX_EXCEEDED").equals("message", "dup")), [4]),
    "nested_contradiction": (lambda q: q.nested("Logs", lambda e: e.equals("type", "A").equals("type", "B")), []),
    "second_array": (lambda q: q.equals("Logs.tags", "x"), []),
    "second_array_negated": (lambda q: q.not_equals("Logs.tags", "x"), [1, 2, 3, 4]),
    "nested_second_array": (lambda q: q.nested("Logs", lambda e: e.equals("tags", "x")), [1]),
    "array_date": (lambda q: q.date_after("Logs.when", "2024-01-03T12:00:00Z"), [2]),
    "two_elements": (lambda q: q.equals("flags", "red").equals("flags", "blue"), [1]),
    "other_class": (lambda q: q.equals("id", "1"), []),
    "other_class_negated": (lambda q: q.not_equals("id", "1"), [1, 2, 3, 4]),
    "same_value_of_two_classes": (lambda q: q.equals("id", 1).equals("id", True), []),
    "same_value_of_two_classes_negated": (lambda q: q.equals("id", 1).not_equals("id", True), [1]),
    "same_value_in_a_list": (lambda q: q.in_("id", [1, 2]).not_in("id", [True, 2]), [1]),
    "in_none": (lambda q: q.in_("note", ["ok", None]), [1, 2, 3, 4]),
    "not_in_none": (lambda q: q.not_in("note", [None]), [2]),
    "nan_literal": (lambda q: q.in_("score", [float("nan"), 5.0]), [3]),
    "contains_ci": (lambda q: q.contains("name", "ET", ignore_case=True), [2]),
    "matches": (lambda q: q.matches("name", "^[a-d].*A$", "i"), [1, 2, 4]),
    "custom": (lambda q: q.custom(lambda c: c("score") / 2 == c("id")), []),
    "custom_python": (lambda q: q.custom(lambda r: len(r["name"]) == 4, python=True), [2]),
    "struct": (lambda q: q.ends_with("meta.owner.name", "e"), [1, 4]),
}


@pytest.mark.parametrize("name", CASES)
def test_predicates(q, name):
    build, want = CASES[name]
    assert sorted(ids(build(q))) == want


def test_orders(q):
    assert ids(q.out().order_by("score")) == [3, 1, 4, 2]
    assert ids(q.out().order_by("score", "desc").then_by("name")) == [2, 1, 4, 3]
    assert ids(q.out().order_by_date("created")) == [1, 4, 2, 3]
    assert ids(q.out().order_by("meta.owner.nickname")) == [2, 1, 3, 4]
    assert ids(q.out().order_by("meta.owner.nickname", nulls="first")) == [1, 3, 4, 2]
    assert ids(q.out().order_by("metrics.values", "desc")) == [4, 2, 1, 3]


def test_windows(q):
    out = q.out().order_by("id")
    assert ids(out.limit(2.9).offset(-3)) == [1, 2]
    assert ids(out.limit(float("inf"))) == []
    assert ids(out.page(2, 3)) == [4]
    assert ids(out.page(0, 0)) == [1]
    assert out.offset(3).first()["id"] == 4
    assert out.limit(0).first() is None
    with pytest.raises(NoRowError):
        q.equals("id", 9).out().first_or_throw()


def test_pages(q):
    p = q.out().order_by("id").paginate(3)
    assert [r["id"] for r in p.data] == [1, 2, 3] and p.total == 4
    assert [r["id"] for r in p.next()] == [4]
    assert p.next() == []
    p.previous(), p.previous(), p.previous()
    assert p.page == 1 and [r["id"] for r in p] == [1, 2, 3]
    assert q.out().paginate(2, total="none").total is None


def test_groups(q):
    got = q.out().group_by("flags").collect()
    assert [(k, [r["id"] for r in v]) for k, v in got.items()] == [("red", [1, 4]), ("blue", [1]), ("green", [2])]
    assert {r["_key"]: r["_count"] for r in q.out().group_by("created", date=True).counts().collect()} == {1704067200000: 2, 1704153600000: 1}
    assert q.out().order_by("score", "desc").limit(1).group_by("active").collect().keys() == {False}
    with pytest.raises(PathError):
        q.out().group_by("meta.owner")


def test_groups_keep_the_order(q):
    assert [(k, [r["id"] for r in v]) for k, v in q.out().order_by("score", "desc").then_by("name", "desc").group_by("active").collect().items()] == [(False, [2]), (True, [4, 1, 3])]
    got = {r["_key"]: [x["id"] for x in r["_rows"]] for r in q.out().order_by("name", "desc").group_by("flags").collected().collect()}
    assert got == {"red": [4, 1], "blue": [1], "green": [2]}


def test_pages_are_sorted_once(q):
    with q.out().order_by("id", "desc").offset(1).limit(2).paginate(1) as p:
        assert p.total == 2 and [r["id"] for r in p.data] == [3] and [r["id"] for r in p.next()] == [2] and p.next() == []
        first = p.placed()
        p.previous()
        assert p.placed() is first
    assert ids(q.out().order_by("score").offset(2)) == [4, 2] and ids(q.out().order_by("id").offset(9)) == []


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_in_any_zone(spark, zone):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    rows = [(1, "2024-01-01", dt.date(2024, 1, 1)), (2, "2024-01-01 05:00:00", dt.date(2024, 1, 2)), (3, "2024-01-01T23:30:00-02:00", None), (4, "soon", dt.date(2024, 1, 3))]
    df = other.createDataFrame(rows, "id long, text string, day date").selectExpr("*", "cast(day as timestamp_ntz) as time")
    q = Query.over(Dataset(df, ("id",)))
    assert ids(q.date_equals("text", "2024-01-01")) == [1] and ids(q.date_after("text", "2024-01-02")) == [3]
    assert ids(q.date_equals("text", "2024-01-02T01:30:00Z")) == [3] and ids(q.date_between("text", "2024-01-01", "2024-01-01T05:00:00Z")) == [1, 2]
    for c in ("day", "time"):
        assert ids(q.date_equals(c, "2024-01-01")) == [1] and ids(q.date_equals(c, "2024-01-01T01:00:00Z")) == []
        assert ids(q.date_after(c, "2024-01-01T12:00:00Z")) == [2, 4] and ids(q.date_after_or_equal(c, "2024-01-02")) == [2, 4]
        assert ids(q.date_before(c, "2024-01-02T00:00:01Z")) == [1, 2] and ids(q.date_before_or_equal(c, "2024-01-02")) == [1, 2] and ids(q.date_before(c, "2024-01-02")) == [1]
        assert ids(q.equals(c, dt.datetime(2024, 1, 2))) == [2] and ids(q.not_equals(c, dt.datetime(2024, 1, 2))) == [1, 3, 4]
        assert ids(q.equals(c, dt.datetime(2024, 1, 2, 3))) == [] and ids(q.not_equals(c, dt.datetime(2024, 1, 2, 3))) == [1, 2, 3, 4]
        assert ids(q.in_(c, [dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1, 7)])) == [4] and ids(q.greater_than(c, dt.datetime(2024, 1, 2))) == [4]
        assert ids(q.out().order_by_date(c, "desc")) == [4, 2, 1, 3]
        assert {r["_key"] for r in q.out().group_by(c).counts().collect()} == {1704067200000, 1704153600000, 1704240000000}
    assert ids(q.out().order_by_date("text")) == [1, 2, 3, 4]


def test_paths_are_checked(q):
    for bad in ("nothing", "meta.nobody", "name.first", ""):
        with pytest.raises(PathError):
            ids(q.equals(bad, 1))
    with pytest.raises(PathError):
        ids(q.out().order_by("meta"))
    with pytest.raises(TypeError):
        q.equals("meta", {"a": 1})


def test_orders_with_ties_and_nulls(spark):
    rows = [(1, "b", float("nan")), (2, None, 2.0), (3, "a", None), (4, "a", 1.0), (5, "b", 2.0)]
    q = Query.over(Dataset.from_rows(spark, rows, "id long, name string, score double", ("id",)))
    assert ids(q.out().order_by("score")) == [4, 2, 5, 1, 3]
    assert ids(q.out().order_by("score", "desc", "first")) == [1, 3, 2, 5, 4]
    assert ids(q.out().order_by("name").then_by("score", "desc")) == [4, 3, 5, 1, 2]
    assert ids(q.greater_than("score", 0)) == [2, 4, 5]
    assert ids(q.not_(lambda g: g.less_than_or_equal("score", 2))) == [1, 3]


def test_search(spark):
    rows = [(1, "al", 5.0, ["red"]), (2, "a_l", 10.0, ["blue"]), (3, "alpha", 8.0, ["red", "blue"]), (4, "gamma", 2.0, [])]
    q = Query.over(Dataset.from_rows(spark, rows, "id long, name string, score double, tags array<string>", ("id",)))
    fuzzy = q.configure_fuzzy(["name"])
    assert ids(fuzzy.search("al")) == [2, 1, 3]
    assert [r["_score"] for r in fuzzy.search("AL").out().result_with_metadata().orderBy("id").collect()] == [34, 36, 34]
    assert ids(q.configure_fuzzy(["name"], order="existing").search("al")) == [1, 2, 3]
    assert ids(fuzzy.search("")) == [1, 2, 3, 4]
    assert ids(fuzzy.search({"fuzzy": {"query": ""}})) == []
    assert ids(q.configure_fuzzy(["name"], require_all=False).search("al").out().order_by("id")) == [1, 2, 3, 4]
    assert ids(fuzzy.search("gam").search("al")) == [2, 1, 3]
    assert ids(fuzzy.search("al").out().limit(2)) == [2, 1]
    assert ids(q.configure_fuzzy(["tags"]).search("rd")) == [1, 3]
    assert ids(q.configure_fuzzy(["name"], normalize=lambda c: F.translate(F.lower(c), "_", "")).search("A_L")) == [1, 2, 3]
    tagged = q.configure_tagger(["x", "y"], [{"tag": "x", "path": "name", "contains": "AL"}, {"tag": "y", "path": "tags", "equals": "blue"}])
    assert ids(tagged.search(["x"])) == [1, 3]
    assert ids(tagged.tags(has=["x", "y"])) == [3]
    assert ids(tagged.tags(not_=["x"], has_any=["y"])) == [2]
    assert [r["_tag_mask"] for r in tagged.tags().out().result_with_metadata().orderBy("id").collect()] == [1, 2, 3, 0]
    assert q.out().result_with_metadata().where("_score is not null or _tag_mask is not null").count() == 0
    for bad in (lambda: q.search("al"), lambda: q.tags(has=["x"]), lambda: tagged.search("al"), lambda: fuzzy.search(["x"])):
        with pytest.raises(ValueError):
            bad()


def test_chains(q):
    a = QueryChain.from_(q.data.schema, lambda b: b.equals("active", True))
    b = QueryChain.from_(q.data.schema, lambda b: b.greater_than("score", 6))
    assert a.plan_id != b.plan_id and a.plan_id == create_chain(lambda x: x.equals("active", True)).plan_id
    assert sorted(r["id"] for r in a.and_(b).execute(q.data)) == [1, 4]
    assert sorted(r["id"] for r in a.or_(b).execute(q.data)) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in q.data.df.transform(a.not_()).collect()) == [2]
    with pytest.raises(PathError):
        QueryChain.from_(q.data.schema, lambda x: x.equals("no", 1))
    r = ChainRegistry()
    r.register("a", a)
    assert r.has("a") and r.names() == ["a"] and r.get("b") is None and r.remove("a") and not r.remove("a")


def test_plans(q):
    _, d = q.custom(lambda r: True, python=True).matches("name", "x").equals("id", 1).equals("id", 1).plan()
    assert d.ordered == ("eq(id)", "matches(name)", "custom") and len(d.dropped) == 1
    for build in (lambda q: q.greater_than("score", 5).less_than("score", 5), lambda q: q.in_("id", [1, 2]).equals("id", 3), lambda q: q.in_("id", [1, 2]).greater_than("id", 7), lambda q: q.equals("id", 1).not_equals("id", 1)):
        node, d = build(q).plan()
        assert d.contradictions and ids(build(q)) == []
    assert not q.equals("flags", "red").equals("flags", "blue").plan()[1].contradictions


def test_reports(q):
    telemetry.clear()
    telemetry.enable()
    q.equals("id", 1).out().result()
    telemetry.metric("m", 2)
    telemetry.enable(False)
    report = telemetry.run_report()
    assert report["rows"] == [1] and report["spans"]["result"]["count"] == 1 and report["metrics"] == {"m": 2}
    assert "eq(id)" in telemetry.format_run_report(report)


def test_runs_that_leave_their_rows_with_the_executors(spark, q, tmp_path, monkeypatch):
    from tessera.source_queries import run_report

    asked, path = q.not_equals("id", 1).out().order_by("id", "desc"), str(tmp_path / "rows")
    want = asked.result()
    orders = spark.range(0, 5000, 1, 7).selectExpr("id as o_orderkey", "if(id % 3 = 0, 'P', 'F') as o_orderstatus")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    with monkeypatch.context() as m:
        m.setattr(type(orders), "collect", None)  # as if the rows didn't fit into the driver
        report = run_report(spark, str(tmp_path))
    assert tuple(report.first()) == (1667, 1, 1)
    assert asked.write(path) == len(want) > 1 and asked.write(format="noop") == len(want)
    assert q.equals("id", 1).equals("id", 2).out().write(format="noop") == 0
    assert spark.read.parquet(path).count() == len(want)


def test_datasets(spark, q):
    d = Dataset.from_schema(spark, SCHEMA, ("id",))
    assert d.is_empty() and d.load(ROWS).length() == 4 and d.load(ROWS).clear().is_empty() and not d.load_from(q.data.df).is_empty()
    assert len(Query.over(q.data.df).out().limit(2).result()) == 2


def evaluate(row, q):
    return (q["eq"] is None or row[1] == q["eq"]) and (q["gt"] is None or (row[2] is not None and row[2] > q["gt"])) and (q["flag"] is None or q["flag"] in row[3]) and (q["log"] is None or any(t == q["log"][0] and n > q["log"][1] for t, n in row[4]))


def test_seeded_differential(spark):
    """Random rows and queries against a plain evaluator."""
    rng = random.Random(6969)
    rows = [
        (i, rng.choice(["Al", "Bo", "Cy", None]), None if rng.random() < 0.1 else float(rng.randrange(50)), rng.sample(["red", "green", "blue"], rng.randrange(3)), [(rng.choice(["WARN", "INFO"]), rng.randrange(9)) for _ in range(rng.randrange(3))])
        for i in range(2000)
    ]
    base = Query.over(Dataset.from_rows(spark, rows, "id long, name string, score double, flags array<string>, logs array<struct<type:string,n:int>>", ("id",)))
    for _ in range(8):
        c = {"eq": rng.choice(["Al", None]), "gt": rng.choice([10.0, 40.0, None]), "flag": rng.choice(["red", None]), "log": rng.choice([("WARN", 4), None])}
        q = base
        q = q.equals("name", c["eq"]) if c["eq"] else q
        q = q.greater_than("score", c["gt"]) if c["gt"] is not None else q
        q = q.equals("flags", c["flag"]) if c["flag"] else q
        q = q.nested("logs", lambda e, c=c: e.equals("type", c["log"][0]).greater_than("n", c["log"][1])) if c["log"] else q
        want = [r for r in rows if evaluate(r, c)]
        want = sorted(want, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))[3:23]
        assert ids(q.out().order_by("score", "desc").offset(3).limit(20)) == [r[0] for r in want]


def test_date_literals():
    from tessera.functions import parse_date

    utc = dt.timezone.utc
    assert parse_date("2026-02-31") == dt.datetime(2026, 3, 3, tzinfo=utc)
    assert parse_date("2024-01-01T02:00:00.5+02:00") == dt.datetime(2024, 1, 1, 0, 0, 0, 500000, tzinfo=utc)
    assert parse_date(0) == dt.datetime(1970, 1, 1, tzinfo=utc)
    for bad in ("2024", "2024-1-1", "2024-13-01", "2024-01-01T25:00:00", True, None, float("nan"), "2024-01-32"):
        assert parse_date(bad) is None


def test_patterns(spark):
    from tessera.functions import java_regex

    df = spark.createDataFrame([("a\n",), ("a",), ("a b",), ("[x]",)], "s string")
    found = lambda p, f="": [r["s"] for r in df.where(F.col("s").rlike(java_regex(p, f))).collect()]
    assert found("a$") == ["a"] and found("a$", "m") == ["a\n", "a"] and found(r"a\sb") == ["a b"] and found(r"[[]x") == ["[x]"]
    with pytest.raises(ValueError):
        java_regex("[^]")
    with pytest.raises(ValueError):
        java_regex("a", "q")
