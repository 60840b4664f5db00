"""Functions, operators and sources: the dialect's meaning, case by case."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyrock.errors import ExecutionError
from tallyrock.functions import (
    abs_of, avg_of, between, clock, coalesce_of, concat_of, count_all, count_distinct_of, count_of, divide, first_of, in_list, is_false,
    length_of, like, lower_of, max_of, min_of, modulo, negate, not_between, not_in_list, sum_of, truth, upper_of,
)
from tallyrock.operators import (
    Item, aggregate, asc, constants, desc, distinct, distinct_ordered, inner_join, join_chain, keep, left_join, limit, order, project,
    qualify, right_join, star, top_k, without_match,
)
from tallyrock.plans.explain import explain
from tallyrock.session import dialect_session, select
from tallyrock.sources import as_inserts, point, span, values
from tallyrock.sources.sinks import table_text, vertical_text

c, lit = F.col, F.lit


@pytest.fixture(scope="module")
def own(spark):
    return dialect_session(spark)


@pytest.fixture(scope="module")
def users(spark):
    return values(spark, [(1, "active", 30), (2, "active", 20), (3, "inactive", 40), (4, None, None)], "id int, status string, age int")


@pytest.fixture(scope="module")
def shop(spark):
    users = values(spark, [(1, "alice"), (2, "bob"), (3, "carol")], "id int, name string")
    orders = values(spark, [(100, 1, 50), (101, 1, 30), (102, 2, 20), (200, 99, 999)], "id int, user_id int, total int")
    payments = values(spark, [(1000, 100, "card")], "id int, order_id int, method string")
    return users, orders, payments


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def expressions():
    NULL = F.lit(None)
    return [
    (upper_of(lit("aé")), "Aé"), (lower_of(lit("AÉ")), "aÉ"), (length_of(lit("é")), 2), (length_of(NULL.cast("string")), None), (abs_of(lit(-3)), 3),
    (concat_of(lit("a"), lit(1), lit(True), lit(False), flags=(2, 3)), "a11"), (concat_of(lit("a"), NULL), None), (coalesce_of(NULL, lit(2)), 2), (coalesce_of(), None),
    (divide(lit(5), lit(2)), 2.5), (divide(lit(4), lit(2)), 2.0), (modulo(lit(7.5), lit(2)), 1), (modulo(lit(-7), lit(2)), -1), (negate(lit(3)), -3), (negate(NULL.cast("int")), None),
    (between(lit(5), 1, 5), True), (between(lit(0), 1, 5), False), (not_between(lit(0), 1, NULL), True), (between(NULL, 1, 5), None),
    (in_list(lit(1), [1, None]), True), (in_list(lit(2), [1, None]), None), (not_in_list(lit(2), [1, None]), None), (in_list(lit(1), []), False),
    (like(lit("a\\b"), "a\\_"), True), (like(lit("line\nbreak"), "line%"), True), (like(lit("Abc"), "a%"), False), (like(lit("abc\n"), "abc"), False), (like(NULL.cast("string"), "a"), None),
    (is_false(lit(1) > lit(2)), True), (is_false(NULL.cast("boolean")), False),
    ]


def test_expressions(spark):
    for k, (expr, want) in enumerate(expressions()):
        assert one(spark, expr) == want, (k, expr)


def test_errors(spark, own):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        own.range(1).select(divide(lit(1), lit(0))).collect()
    with pytest.raises(Exception, match="ZERO"):
        own.range(1).select(modulo(lit(1), lit(0))).collect()
    with pytest.raises(ExecutionError):
        keep(spark.range(1), lit("text"))
    with pytest.raises(ExecutionError):
        star(spark.range(1), sources=2)


def test_clock(spark):
    now, today = clock(datetime(2024, 6, 15, 12))
    row = spark.range(3).select(now.alias("n"), today.alias("d")).distinct().collect()
    assert len(row) == 1 and row[0]["n"] == datetime(2024, 6, 15, 12) and str(row[0]["d"]) == "2024-06-15"


def test_filter_and_truth(users):
    assert [r["id"] for r in keep(users, c("age") > 25).collect()] == [1, 3]
    assert [r["id"] for r in keep(users, modulo(c("id"), lit(2))).collect()] == [1, 3]
    assert users.select(truth(users, c("age"))).collect()[3][0] is None


def test_labels(users):
    assert project(users, "id", ("x", c("age")), Item(upper_of(c("status")), function="UPPER"), c("age") + 1).columns == ["id", "x", "UPPER", "column4"]
    assert constants(users.sparkSession, lit(1), ("a", lit(2))).collect() == [(1, 2)]


def test_aggregate(users):
    got = aggregate(users, {"status": c("status")}, {"n": count_all(), "total": sum_of(c("age")), "avg": avg_of(c("age"))}).collect()
    assert {tuple(r) for r in got} == {("active", 2, 50, 25.0), ("inactive", 1, 40, 40.0), (None, 1, None, None)}
    assert aggregate(keep(users, lit(False)), items={"n": count_all(), "s": sum_of(c("age")), "f": first_of(c("id"))}).collect() == [(0, None, None)]
    assert aggregate(users, items={"n": count_of(c("age")), "d": count_distinct_of(c("status")), "low": min_of(c("age")), "high": max_of(c("status"))}).collect() == [(3, 2, 20, "inactive")]
    assert aggregate(users, {"status": c("status")}, {"x": sum_of(c("age")) + 10}, having=count_all() > 1).collect() == [("active", 60)]
    assert aggregate(users, items={"n": count_all()}, having=max_of(c("age")) > 100).collect() == []
    assert sorted(r[0] or "" for r in aggregate(users, {"status": c("status")}).collect()) == ["", "active", "inactive"]
    twice = users.union(users)
    assert aggregate(twice, items={"s": sum_of(c("age"), distinct=True), "a": avg_of(c("age"), distinct=True)}).collect() == [(90, 30.0)]


def test_joins(shop):
    users, orders, payments = shop
    on = c("u.id") == c("o.user_id")
    u, o = qualify(users, "u"), qualify(orders, "o")
    assert sorted(map(tuple, project(inner_join(u, o, on), "u.name", "o.total").collect())) == [("alice", 30), ("alice", 50), ("bob", 20)]
    assert ("carol", None) in [tuple(r) for r in project(left_join(u, o, on), "u.name", "o.total").collect()]
    assert (None, 999) in [tuple(r) for r in project(right_join(u, o, on), "u.name", "o.total").collect()]
    assert [r["name"] for r in project(without_match(u, o, on), "u.name").collect()] == ["carol"]
    chain = join_chain(u, (o, on, "inner"), (qualify(payments, "p"), c("p.order_id") == c("o.id"), "left"))
    assert sorted((r[0], r[1] or "") for r in project(chain, "u.name", "p.method").collect()) == [("alice", ""), ("alice", "card"), ("bob", "")]
    pairs = inner_join(qualify(users, "a"), qualify(users, "b"), c("a.id") < c("b.id"))
    assert project(pairs, "a.id", "b.id").columns == ["id", "id"] and pairs.count() == 3
    assert "LeftAnti" in "\n".join(r["plan"] for r in explain(without_match(u, o, on)).collect())


def test_order_limit_distinct(users):
    assert [r["id"] for r in order(users, asc("age"), asc("id")).collect()] == [4, 2, 1, 3]
    assert [r["id"] for r in order(users, desc("age"), asc("id")).collect()] == [3, 1, 2, 4]
    ordered = order(users, asc("id"))
    assert [[r["id"] for r in limit(ordered, *x).collect()] for x in ((2, 1), (0, 0), (None, 3))] == [[2, 3], [], [4]]
    assert [r["id"] for r in top_k(users, 2, desc("age")).collect()] == [3, 1]
    assert distinct(users.select("status")).count() == 3
    assert [r["status"] for r in distinct_ordered(users, ["status"], desc("age")).collect()] == ["inactive", "active", None]


def test_scans(users):
    assert point(users, "id", 2).count() == 1 and point(users, "status", None).count() == 0
    assert [r["id"] for r in span(users, "id", 1, 3, low_open=True, high_open=True).collect()] == [2]


def test_pushdown(spark, sf):
    from tallyrock.sources import scan

    text = "\n".join(r["plan"] for r in explain(project(point(scan(spark, sf, "orders"), "o_orderkey", 7), "o_orderkey", "o_custkey")).collect())
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_sql_text(own, users):
    own.createDataFrame(users.collect(), users.schema).createOrReplaceTempView("users")
    assert select(own, 'SELECT "id" FROM users WHERE status = ? AND age > ?', ["active", 25]).collect() == [(1,)]
    assert select(own, "SELECT id FROM users WHERE status = ?", ["' OR 1 = 1 --"]).collect() == []
    with pytest.raises(Exception, match="UNRESOLVED"):
        select(own, "SELECT ID FROM users")
    with pytest.raises(Exception, match="MISSING_AGGREGATION|UNRESOLVED"):
        select(own, "SELECT age AS a, count(*) FROM users GROUP BY a").collect()
    assert select(own, "SELECT id FROM users WHERE age > (SELECT avg(age) FROM users)").collect() == [(3,)]


def test_sinks(spark):
    df = values(spark, [(1, "it's", True, bytearray(b"\n")), (None, None, None, None)], "a int, b string, c boolean, d binary")
    assert [r["statement"] for r in as_inserts(df, "t").collect()] == [
        """INSERT INTO "t" ("a", "b", "c", "d") VALUES (1, 'it''s', TRUE, X'0A');""", 'INSERT INTO "t" ("a", "b", "c", "d") VALUES (NULL, NULL, NULL, NULL);']  # fmt: skip
    assert "it's" in table_text(df) and "RECORD 0" in vertical_text(df)
