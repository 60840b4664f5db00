"""The relational queries by name over the test tables, with DuckDB SQL that gives the same rows.

Money columns are doubles, whose sums depend on the order of addition; sums are therefore taken
over exact decimals, which also stay exact at any scale."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import (
    abs_of, avg_of, between, clock, coalesce_of, concat_of, count_all, count_distinct_of, count_of, divide, first_of, in_list, length_of, like, lower_of,
    max_of, min_of, modulo, negate, not_between, not_in_list, not_like, sum_of, upper_of,
)
from ..operators import (
    Item, aggregate, asc, desc, distinct, distinct_ordered, inner_join, join_chain, keep, left_join, limit, order, project, qualify,
    right_join, star, top_k, without_match,
)
from ..session import new_folder, on_tables, select
from ..sources import as_inserts, csv_lines, point, scan, span
from .explain import explain
from ..tables import BIGINT, INT, VARCHAR, Check, Column_, Database, ForeignKey, Index, Table, Unique

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def total(value: Column) -> Column:
    """An exact sum of money, which has two digits in the test data, as a double."""
    return sum_of(value.cast("decimal(18,2)")).cast("double")


# --- scans and projections -------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer")
def scan_project(s, d):
    return project(scan(s, d, "customer"), "c_custkey", "c_name")


@query("SELECT * FROM customer")
def select_star(s, d):
    return star(scan(s, d, "customer"))


@query("SELECT c_custkey AS key, upper(c_mktsegment) AS \"UPPER\", c_nationkey + 1 AS column3 FROM customer")
def labels(s, d):
    return project(scan(s, d, "customer"), ("key", c("c_custkey")), Item(upper_of(c("c_mktsegment")), function="UPPER"), c("c_nationkey") + 1)


@query("SELECT count(*)::BIGINT AS n, min(o_orderkey) AS low FROM orders WHERE o_orderkey = 7")
def index_equals(s, d):
    return aggregate(point(scan(s, d, "orders"), "o_orderkey", 7), items={"n": count_all(), "low": min_of(c("o_orderkey"))})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def index_range(s, d):
    return project(span(scan(s, d, "orders"), "o_orderkey", 100, 300, high_open=True), "o_orderkey", "o_custkey")


@query("SELECT e.event_id FROM events e JOIN (SELECT max(event_id) AS m FROM events) x ON e.event_id = x.m")
def sql_derived_table(s, d):
    return select(on_tables(s, d, "events"), "SELECT e.event_id FROM events e JOIN (SELECT max(event_id) AS m FROM events) x ON e.event_id = x.m")


# --- filters and expressions -----------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(s, d):
    return project(keep(scan(s, d, "orders"), c("o_orderstatus") == "F"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000")
def filter_range(s, d):
    return project(span(scan(s, d, "orders"), "o_totalprice", 1000, 50000, low_open=True), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus <> 'F' OR o_totalprice < 5000) AND NOT (o_custkey > 100)")
def filter_and_or_not(s, d):
    return project(keep(scan(s, d, "orders"), ((c("o_orderstatus") != "F") | (c("o_totalprice") < 5000)) & ~(c("o_custkey") > 100)), "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 2 <> 0")
def filter_number_as_truth(s, d):
    return project(keep(scan(s, d, "customer"), modulo(c("c_nationkey"), F.lit(2))), "c_custkey")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def arith(s, d):
    return project(scan(s, d, "lineitem"), "l_orderkey", "l_linenumber", ("net", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4)))


@query("SELECT p_partkey, p_size / 2 AS half FROM part")
def division(s, d):
    return project(scan(s, d, "part"), "p_partkey", ("half", divide(c("p_size"), F.lit(2))))


@query("SELECT p_partkey, trunc(p_retailprice)::BIGINT % 7 AS left_over FROM part")
def modulo_cut(s, d):
    return project(scan(s, d, "part"), "p_partkey", ("left_over", modulo(c("p_retailprice"), F.lit(7))))


@query("SELECT c_custkey, -c_acctbal AS owed FROM customer")
def unary_neg(s, d):
    return project(scan(s, d, "customer"), "c_custkey", ("owed", negate(c("c_acctbal"))))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def between_bounds(s, d):
    return project(keep(scan(s, d, "part"), between(c("p_size"), 10, 20)), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
def not_between_bounds(s, d):
    return project(keep(scan(s, d, "part"), not_between(c("p_size"), 10, 20)), "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list_items(s, d):
    return project(keep(scan(s, d, "customer"), in_list(c("c_mktsegment"), ["BUILDING", "MACHINERY"])), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def not_in_list_items(s, d):
    return project(keep(scan(s, d, "customer"), not_in_list(c("c_mktsegment"), ["BUILDING", "MACHINERY"])), "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_'")
def like_pattern(s, d):
    return project(keep(scan(s, d, "part"), like(c("p_name"), "%1_")), "p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%'")
def not_like_pattern(s, d):
    return project(keep(scan(s, d, "part"), not_like(c("p_type"), "%A%")), "p_partkey")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NULL")
def is_null(s, d):
    joined = left_join(scan(s, d, "customer"), scan(s, d, "orders"), (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > 100000))
    return project(keep(joined, c("o_orderkey").isNull()), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 20000 AND o_orderstatus = 'O'")
def placeholder(s, d):
    return select(on_tables(s, d, "orders"), "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", [20000, "O"])


@query("""SELECT c_custkey, o_orderkey, o_totalprice > 1000 AND c_custkey < 50 AS both, o_totalprice > 1000 OR c_custkey < 50 AS either,
NOT (o_totalprice > 1000) AS neither, o_custkey IN (1, 2, NULL) AS listed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'""")
def three_valued(s, d):
    joined = left_join(scan(s, d, "customer"), scan(s, d, "orders"), (c("o_custkey") == c("c_custkey")) & (c("o_orderstatus") == "F"))
    dear, early = c("o_totalprice") > 1000, c("c_custkey") < 50
    return project(joined, "c_custkey", "o_orderkey", ("both", dear & early), ("either", dear | early), ("neither", ~dear), ("listed", in_list(c("o_custkey"), [1, 2, None])))


# --- scalar functions ------------------------------------------------------------------------

_UP = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(f"SELECT doc_id, sha256(translate(text, {_UP})) AS digest FROM documents")
def fn_upper(s, d):
    return project(scan(s, d, "documents"), "doc_id", ("digest", F.sha2(upper_of(c("text")), 256)))


@query(f"SELECT doc_id, sha256(translate(text, {_LOW})) AS digest FROM documents")
def fn_lower(s, d):
    return project(scan(s, d, "documents"), "doc_id", ("digest", F.sha2(lower_of(c("text")), 256)))


@query("SELECT doc_id, strlen(text)::INTEGER AS bytes FROM documents")
def fn_length(s, d):
    return project(scan(s, d, "documents"), "doc_id", ("bytes", length_of(c("text"))))


@query("SELECT s_suppkey, abs(s_acctbal) AS size FROM supplier")
def fn_abs(s, d):
    return project(scan(s, d, "supplier"), "s_suppkey", ("size", abs_of(c("s_acctbal"))))


@query("SELECT c_custkey, c_name || '/' || c_nationkey || CASE WHEN c_nationkey > 12 THEN '1' ELSE '' END AS text FROM customer")
def fn_concat(s, d):
    return project(scan(s, d, "customer"), "c_custkey", ("text", concat_of(c("c_name"), F.lit("/"), c("c_nationkey"), c("c_nationkey") > 12, flags=(3,))))


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def fn_coalesce(s, d):
    joined = left_join(scan(s, d, "customer"), scan(s, d, "orders"), (c("o_custkey") == c("c_custkey")) & (c("o_orderstatus") == "P"))
    return project(joined, "c_custkey", ("first_order", coalesce_of(c("o_orderkey"), F.lit(-1).cast("long"))))


# --- joins -----------------------------------------------------------------------------------


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner_hash(s, d):
    joined = inner_join(qualify(scan(s, d, "orders"), "o"), qualify(scan(s, d, "customer"), "c"), c("o.o_custkey") == c("c.c_custkey"))
    return project(joined, "o.o_orderkey", "c.c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10")
def join_multi_conjunct(s, d):
    return project(inner_join(scan(s, d, "orders"), scan(s, d, "customer"), (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > c("c_acctbal") * 10)), "o_orderkey", "c_name")


@query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey")
def join_theta(s, d):
    joined = inner_join(qualify(scan(s, d, "supplier"), "s"), qualify(scan(s, d, "nation"), "n"), c("s.s_nationkey") < c("n.n_nationkey"))
    return project(joined, "s.s_suppkey", "n.n_name")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(s, d):
    return aggregate(left_join(scan(s, d, "customer"), scan(s, d, "orders"), c("o_custkey") == c("c_custkey")), {"c_custkey": c("c_custkey")}, {"n_orders": count_of(c("o_orderkey"))})


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(s, d):
    return project(right_join(scan(s, d, "supplier"), scan(s, d, "nation"), c("s_nationkey") == c("n_nationkey")), "n_name", "s_suppkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(s, d):
    joined = join_chain(scan(s, d, "customer"), (scan(s, d, "nation"), c("c_nationkey") == c("n_nationkey"), "inner"), (scan(s, d, "region"), c("n_regionkey") == c("r_regionkey"), "inner"))
    return project(joined, "c_custkey", "n_name", "r_name")


@query("SELECT a.l_orderkey, a.l_linenumber AS one, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber < b.l_linenumber")
def join_self(s, d):
    lines = scan(s, d, "lineitem")
    joined = inner_join(qualify(lines, "a"), qualify(lines, "b"), c("a.l_orderkey") == c("b.l_orderkey"))
    return project(keep(joined, c("a.l_linenumber") < c("b.l_linenumber")), "a.l_orderkey", ("one", c("a.l_linenumber")), ("other", c("b.l_linenumber")))


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def anti_via_left(s, d):
    return project(without_match(scan(s, d, "customer"), scan(s, d, "orders"), c("o_custkey") == c("c_custkey")), "c_custkey")


# --- aggregates ------------------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
def agg_global(s, d):
    return aggregate(scan(s, d, "lineitem"), items={"n": count_all(), "quantity": total(c("l_quantity")), "first": min_of(c("l_shipdate")), "last": max_of(c("l_shipdate"))})


@query("SELECT count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS total, max(c_name) AS name FROM customer WHERE c_custkey < 0")
def agg_empty(s, d):
    return aggregate(keep(scan(s, d, "customer"), c("c_custkey") < 0), items={"n": count_all(), "total": sum_of(c("c_custkey")), "name": max_of(c("c_name"))})


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity,
sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_group(s, d):
    return aggregate(
        scan(s, d, "lineitem"), {"l_returnflag": c("l_returnflag"), "l_linestatus": c("l_linestatus")},
        {"n": count_all(), "quantity": total(c("l_quantity")), "price": total(c("l_extendedprice")), "discount": F.round(avg_of(c("l_discount")), 6)},
    )


@query("SELECT p_size % 5 AS class, count(*)::BIGINT AS n FROM part GROUP BY p_size % 5")
def agg_expr_key(s, d):
    return aggregate(scan(s, d, "part"), {"class": c("p_size") % 5}, {"n": count_all()})


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def count_distinct(s, d):
    return aggregate(scan(s, d, "events"), {"event_type": c("event_type")}, {"users": count_distinct_of(c("user_id")), "n": count_all()})


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 50000 AND count(*) > 2")
def having(s, d):
    return aggregate(scan(s, d, "orders"), {"o_custkey": c("o_custkey")}, {"n": count_all()}, having=(max_of(c("o_totalprice")) > 50000) & (count_all() > 2))


@query("SELECT o_orderstatus, sum(o_custkey)::BIGINT + 10 AS shifted, -count(*)::BIGINT AS minus FROM orders GROUP BY o_orderstatus")
def agg_arith(s, d):
    return aggregate(scan(s, d, "orders"), {"o_orderstatus": c("o_orderstatus")}, {"shifted": sum_of(c("o_custkey")) + 10, "minus": negate(count_all())})


@query("SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total, round(avg(c_acctbal), 4) AS middle FROM customer GROUP BY c_nationkey")
def sum_avg_min_max(s, d):
    b = c("c_acctbal")
    return aggregate(scan(s, d, "customer"), {"c_nationkey": c("c_nationkey")}, {"low": min_of(b), "high": max_of(b), "total": total(b), "middle": F.round(avg_of(b), 4)})


@query("SELECT o_orderstatus, sum(DISTINCT o_custkey)::BIGINT AS total FROM orders GROUP BY o_orderstatus")
def sum_distinct(s, d):
    return aggregate(scan(s, d, "orders"), {"o_orderstatus": c("o_orderstatus")}, {"total": sum_of(c("o_custkey"), distinct=True)})


@query("SELECT o_orderstatus, coalesce(max(CASE WHEN o_totalprice < 0 THEN o_custkey END), -1) AS found FROM orders GROUP BY o_orderstatus")
def agg_in_function(s, d):
    return aggregate(scan(s, d, "orders"), {"o_orderstatus": c("o_orderstatus")}, {"found": coalesce_of(max_of(F.when(c("o_totalprice") < 0, c("o_custkey"))), F.lit(-1).cast("long"))})


# --- distinct, order, limit ------------------------------------------------------------------


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(s, d):
    return distinct(project(scan(s, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("SELECT p_brand, min(p_retailprice) AS least FROM part GROUP BY p_brand ORDER BY least, p_brand LIMIT 5")
def distinct_order_unselected(s, d):
    last = lambda key: c(key).asc_nulls_last()  # noqa: E731  (as min and the SQL's ORDER BY have it)
    ranked = distinct_ordered(scan(s, d, "part"), ["p_brand"], last("p_retailprice"), last("p_brand"))
    brands = limit(ranked, 5)
    least = aggregate(scan(s, d, "part"), {"brand": c("p_brand")}, {"least": min_of(c("p_retailprice"))})
    return order(project(brands.join(least, c("p_brand").eqNullSafe(c("brand"))), "p_brand", "least"), last("least"), last("p_brand"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def order_limit(s, d):
    return limit(order(project(scan(s, d, "orders"), "o_orderkey", "o_totalprice"), desc("o_totalprice"), asc("o_orderkey")), 20)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey OFFSET 5")
def order_offset(s, d):
    return limit(order(project(scan(s, d, "supplier"), "s_suppkey", "s_name"), asc("s_name"), asc("s_suppkey")), offset=5)


@query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
def order_unselected(s, d):
    return project(limit(order(scan(s, d, "customer"), asc("c_acctbal"), asc("c_custkey")), 10, 5), "c_name")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top_rows(s, d):
    return top_k(project(scan(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice"), 100, desc("l_extendedprice"), asc("l_orderkey"), asc("l_linenumber"))


FLAGSHIP = """SELECT n.n_name, count(o.o_orderkey) AS n_orders, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_totalprice > 1000 GROUP BY n.n_name HAVING count(o.o_orderkey) > 1 ORDER BY total DESC, n_name LIMIT 10"""


@query(FLAGSHIP)
def revenue_by_nation(s, d):
    return select(on_tables(s, d, "orders", "customer", "nation"), FLAGSHIP)


# --- declared tables -------------------------------------------------------------------------


def world(s: SparkSession, d: str, on_delete: str = "cascade", on_update: str = "cascade") -> Database:
    """customer and orders of the test tables as declared tables; orders follow their customers."""
    db = Database(s)
    db.create_table(Table(
        "customer", (Column_("c_custkey", BIGINT), Column_("c_name", VARCHAR(50), not_null=True), Column_("c_nationkey", INT)),
        (Unique(("c_custkey",), primary=True),), (Check("c_custkey >= 0"),),
    ))
    db.create_table(Table(
        "orders", (Column_("o_orderkey", BIGINT), Column_("o_custkey", BIGINT), Column_("o_orderstatus", VARCHAR(1), default="O"), Column_("o_totalprice", BIGINT)),
        (Unique(("o_orderkey",), primary=True),), (Check("o_totalprice >= 0"),), (ForeignKey(("o_custkey",), "customer", ("c_custkey",), on_delete, on_update),),
    ))
    db.insert("customer", scan(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
    db.insert("orders", scan(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor("o_totalprice").alias("o_totalprice")))
    return db


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, floor(o_totalprice)::BIGINT AS o_totalprice FROM orders"


@query(f"{_ORDERS} UNION ALL SELECT -1, 5, 'O', 10 UNION ALL SELECT -2, 6, 'O', 20")
def dml_insert(s, d):
    db = world(s, d)
    db.insert("orders", [(-1, 5, 10), (-2, 6, 20)], ["o_orderkey", "o_custkey", "o_totalprice"])
    return db.table("orders")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice FROM ({_ORDERS})")
def dml_update(s, d):
    db = world(s, d)
    db.update("orders", {"o_totalprice": c("o_totalprice") + 100}, c("o_orderstatus") == "F")
    return db.table("orders")


@query(f"SELECT * FROM ({_ORDERS}) WHERE NOT coalesce(o_totalprice > 30000, false)")
def dml_delete(s, d):
    db = world(s, d)
    db.delete("orders", c("o_totalprice") > 30000)
    return db.table("orders")


@query(f"SELECT * FROM ({_ORDERS}) WHERE o_custkey % 10 <> 1")
def dml_delete_cascade(s, d):
    db = world(s, d)
    db.delete("customer", c("c_custkey") % 10 == 1)
    return db.table("orders")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 2 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM ({_ORDERS})")
def dml_delete_set_null(s, d):
    db = world(s, d, on_delete="set null")
    db.delete("customer", c("c_custkey") % 10 == 2)
    return db.table("orders")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN o_custkey + 100000000 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM ({_ORDERS})")
def dml_update_cascade(s, d):
    db = world(s, d)
    db.update("customer", {"c_custkey": c("c_custkey") + 100_000_000}, c("c_custkey") % 10 == 3)
    return db.table("orders")


@query("SELECT c_custkey, c_name, c_nationkey, 7 AS extra FROM customer")
def alter_add(s, d):
    db = world(s, d)
    db.add_column("customer", Column_("extra", INT, not_null=True, default=7))
    return db.table("customer")


@query("SELECT c_custkey, c_nationkey FROM customer")
def alter_drop(s, d):
    db = world(s, d)
    db.drop_column("customer", "c_name")
    return db.table("customer")


@query("SELECT count(*)::BIGINT AS n FROM orders")
def index_unique(s, d):
    db = world(s, d)
    db.create_index("orders", Index("orders_by_key", ("o_orderkey",), unique=True))
    return aggregate(db.table("orders"), items={"n": count_all()})


@query(_ORDERS)
def txn_rollback(s, d):
    db = world(s, d)
    before = db.version()
    if db.delete("orders", c("o_orderstatus") == "F"):
        db.back_to(before)
    return db.table("orders")


@query(f"SELECT * FROM ({_ORDERS}) WHERE o_orderkey > 10")
def savepoint(s, d):
    db = world(s, d)
    db.delete("orders", c("o_orderkey") <= 10)
    kept = db.version()
    if db.delete("orders", c("o_orderkey") <= 100):
        db.back_to(kept)
    return db.table("orders")


def lines(s: SparkSession, d: str, on_update: str = "cascade") -> Database:
    """The tables of ``world`` and a third one: notes on orders, which name the order's key and customer."""
    db = Database(s)
    db.create_table(Table("customer", (Column_("c_custkey", BIGINT), Column_("bal", BIGINT), Column_("balance", BIGINT)), (Unique(("c_custkey",), primary=True),), (Check("balance >= 0"),)))
    db.create_table(Table(
        "orders", (Column_("o_orderkey", BIGINT), Column_("o_custkey", BIGINT)), (Unique(("o_orderkey",), primary=True), Unique(("o_custkey", "o_orderkey"))),
        (), (ForeignKey(("o_custkey",), "customer", ("c_custkey",), "restrict", "cascade"),),
    ))
    db.create_table(Table(
        "notes", (Column_("n_custkey", BIGINT), Column_("n_orderkey", BIGINT), Column_("n_status", VARCHAR(1))), (), (),
        (ForeignKey(("n_custkey", "n_orderkey"), "orders", ("o_custkey", "o_orderkey"), "restrict", on_update),),
    ))
    orders = scan(s, d, "orders")
    db.insert("customer", scan(s, d, "customer").select("c_custkey", F.lit(1).alias("bal"), F.lit(2).alias("balance")))
    db.insert("orders", orders.select("o_orderkey", "o_custkey"))
    db.insert("notes", orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["n_custkey", "n_orderkey", "n_status"])
    return db


@query("SELECT CASE WHEN o_custkey % 10 = 3 THEN o_custkey + 100000000 ELSE o_custkey END AS n_custkey, o_orderkey AS n_orderkey, o_orderstatus AS n_status FROM orders")
def dml_update_cascade_deep(s, d):
    db = lines(s, d)
    db.update("customer", {"c_custkey": c("c_custkey") + 100_000_000}, c("c_custkey") % 10 == 3)
    return db.table("notes")


@query("SELECT c_custkey, 2::BIGINT AS balance FROM customer")
def alter_drop_similar_name(s, d):
    db = lines(s, d)
    db.drop_column("customer", "bal")
    return db.table("customer")


@query("""SELECT * FROM (VALUES ('delete a referenced row', 'ConstraintError'), ('change a key that a restricted row names, one level down', 'ConstraintError'), ('insert a row without its parent', 'ConstraintError'),
('insert a key twice', 'ConstraintError'), ('break a check', 'ConstraintError'), ('insert a text as a number', 'ValueTypeError'), ('drop a referenced table', 'SchemaError'),
('drop a column that a check reads', 'SchemaError'), ('read a table that is not there', 'SchemaError'), ('delete a row that nothing names', 'none')) AS t(statement, error)""")
def refused(s, d):
    """What constraints refuse, and by which error."""
    db = lines(s, d, "restrict")
    db.insert("customer", [(-1, 1, 2)])
    statements = {
        "delete a referenced row": lambda: db.delete("customer", c("c_custkey").isin([r[0] for r in scan(s, d, "orders").select("o_custkey").limit(1).collect()])),
        "change a key that a restricted row names, one level down": lambda: db.update("customer", {"c_custkey": c("c_custkey") + 100_000_000}, c("c_custkey") >= 0),
        "insert a row without its parent": lambda: db.insert("orders", [(-5, -99)]),
        "insert a key twice": lambda: db.insert("customer", [(-1, 1, 2)]),
        "break a check": lambda: db.update("customer", {"balance": -1}),
        "insert a text as a number": lambda: db.insert("customer", [("one", 1, 2)]),
        "drop a referenced table": lambda: db.drop_table("orders"),
        "drop a column that a check reads": lambda: db.drop_column("customer", "balance"),
        "read a table that is not there": lambda: db.table("nothing"),
        "delete a row that nothing names": lambda: db.delete("customer", c("c_custkey") == -1),
    }
    found = []
    for name, statement in statements.items():
        try:
            statement()
            found.append((name, "none"))
        except EngineError as e:
            found.append((name, type(e).__name__))
    return s.createDataFrame(found, "statement string, error string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 1")
def drop_table(s, d):
    db = world(s, d, on_delete="restrict")
    db.drop_table("orders")
    db.delete("customer", c("c_custkey") % 10 == 1)  # no order restricts it any more
    return project(db.table("customer"), "c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT 900000001, c_name FROM customer WHERE c_custkey = 1")
def drop_index(s, d):
    db = world(s, d)
    db.create_index("customer", Index("names", ("c_name",), unique=True))
    again = db.table("customer").where("c_custkey = 1").withColumn("c_custkey", F.lit(900_000_001).cast("long"))
    try:
        db.insert("customer", again)
    except EngineError:
        db.drop_index("customer", "names")
        db.insert("customer", again)
    return project(db.table("customer"), "c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def dump_restore(s, d):
    path = new_folder(s, "dump")
    world(s, d).dump(path)
    copy = Database(s)
    copy.restore(path)
    return copy.table("customer")


@query("SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def format_csv(s, d):
    return csv_lines(scan(s, d, "nation"))


@query("SELECT (SELECT count(*) FROM nation)::BIGINT AS n, 7 * 6 AS product")
def no_from(s, d):
    return select(on_tables(s, d, "nation"), "SELECT (SELECT count(*) FROM nation) AS n, 7 * 6 AS product")


@query("SELECT a.n_name AS n_name, r_name, b.n_nationkey AS other FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey")
def column_references(s, d):
    """Names with their table, and without where only one table has them."""
    joined = join_chain(
        qualify(scan(s, d, "nation"), "a"), (scan(s, d, "region"), c("a.n_regionkey") == c("r_regionkey"), "inner"),
        (qualify(scan(s, d, "nation"), "b"), c("b.n_regionkey") == c("r_regionkey"), "inner"),
    )
    return project(joined, "a.n_name", "r_name", ("other", c("b.n_nationkey")))


@query("SELECT n_nationkey, any_value(n_name) AS n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def bare_item(s, d):
    joined = inner_join(scan(s, d, "customer"), scan(s, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return aggregate(joined, {"n_nationkey": c("n_nationkey")}, {"n_name": first_of(c("n_name")), "n": count_all()})


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-06-15 12:00:00' AS past, TIMESTAMP '1998-06-15 12:00:00' AS moment, DATE '1998-06-15' AS today FROM orders")
def clock_columns(s, d):
    moment, today = clock(datetime(1998, 6, 15, 12))
    return project(scan(s, d, "orders"), "o_orderkey", ("past", c("o_orderdate") < moment), ("moment", moment), ("today", today))


@query("SELECT count(*) > 0 AS pushed, count(*) < 25 AS narrow FROM nation WHERE n_nationkey = 7")
def explain_pushdown(s, d):
    """Whether the plan of a lookup pushes its filter to the files, and reads one column alone."""
    plan = explain(project(point(scan(s, d, "nation"), "n_nationkey", 7), "n_nationkey"))
    return aggregate(plan, items={"pushed": max_of(c("plan").contains("EqualTo(n_nationkey,7)")), "narrow": max_of(c("plan").contains("ReadSchema: struct<n_nationkey:int>"))})


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_'")
def like_matches(s, d):
    return project(keep(scan(s, d, "customer"), like(c("c_name"), "%1_")), "c_custkey", "c_name")


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def anti_of_dear_orders(s, d):
    dear = keep(scan(s, d, "orders"), c("o_totalprice") > 400000)
    return project(without_match(scan(s, d, "customer"), dear, c("o_custkey") == c("c_custkey")), "c_custkey")


@query("""SELECT c_custkey, o_orderkey, o_custkey BETWEEN 5 AND 50 AS inside, o_custkey NOT BETWEEN o_orderkey AND 5 AS outside, o_orderstatus LIKE 'F%' AS alike,
o_orderpriority NOT LIKE '%-%' AS unlike, o_orderkey NOT IN (1, 2) AS unlisted, o_orderkey NOT IN (1, NULL) AS unsure, c_custkey IN (1, NULL) AS listed
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000""")
def null_predicates(s, d):
    joined = left_join(scan(s, d, "customer"), scan(s, d, "orders"), (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > 400000))
    return project(
        joined, "c_custkey", "o_orderkey", ("inside", between(c("o_custkey"), 5, 50)), ("outside", not_between(c("o_custkey"), c("o_orderkey"), 5)), ("alike", like(c("o_orderstatus"), "F%")),
        ("unlike", not_like(c("o_orderpriority"), "%-%")), ("unlisted", not_in_list(c("o_orderkey"), [1, 2])), ("unsure", not_in_list(c("o_orderkey"), [1, None])), ("listed", in_list(c("c_custkey"), [1, None])),
    )


@query("""SELECT 'INSERT INTO "customer" ("c_custkey", "c_name", "c_nationkey") VALUES (' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ' || c_nationkey || ');' AS statement FROM customer""")
def export_inserts(s, d):
    return as_inserts(scan(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "customer")
