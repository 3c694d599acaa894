"""The engine's registered queries over the supplied tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.errors import EngineError
from quernstone.functions.expressions import Binary, Literal, Name
from quernstone.operators import constraints, dml, joins, scans
from quernstone.plans.session import Session
from quernstone.plans.shell import render
from quernstone.sources.catalog import ColumnDef
from quernstone.sources.files import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def external(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str):
    def register(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _on(table: str, change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: change(external(spark, sf_dir, table))


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


# scans, projections, filters
_add("scan_full", _on("nation", scans.scan), "SELECT * FROM nation")
_add("scan_lineitem", _on("lineitem", scans.scan), "SELECT * FROM lineitem")
_add("scan_project", _on("customer", lambda t: scans.scan(t, ["c_custkey", "c_name"])), "SELECT c_custkey, c_name FROM customer")
_add("pk_lookup", _on("orders", lambda t: scans.point_lookup(t, "o_orderkey", 5)), "SELECT * FROM orders WHERE o_orderkey = 5")
_add("pk_lookup_miss", _on("orders", lambda t: scans.point_lookup(t, "o_orderkey", -1)), "SELECT * FROM orders WHERE o_orderkey = -1")
_add("filter_eq_string", _on("customer", lambda t: scans.equal(t, "c_mktsegment", "BUILDING")), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("filter_eq_int", _on("part", lambda t: scans.equal(t, "p_size", 10)), "SELECT * FROM part WHERE p_size = 10")
_add("filter_eq_text_for_int", _on("part", lambda t: scans.equal(t, "p_size", "010")), "SELECT * FROM part WHERE p_size = 10")
_add("filter_eq_float", _on("lineitem", lambda t: scans.equal(t, "l_quantity", 20.0)), "SELECT * FROM lineitem WHERE l_quantity = 20.0")
_add("filter_eq_null", _on("orders", lambda t: scans.equal(t, "o_orderstatus", None)), "SELECT * FROM orders WHERE o_orderstatus IS NULL")
_add("range_scan", _on("orders", lambda t: scans.range_scan(t, "o_orderkey", 100)), "SELECT * FROM orders WHERE o_orderkey >= 100")
_add("range_scan_between", _on("orders", lambda t: scans.range_scan(t, "o_orderkey", 100, 200)), "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")

# comparisons
for _name, _op in (("eq", "="), ("ne", "!="), ("ne_brackets", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    _add(f"cmp_{_name}", _on("part", lambda t, op=_op: scans.where(t, Binary(op, Name("p_size"), Literal(25)))), f"SELECT * FROM part WHERE p_size {_op} 25")
_add("cmp_string_lt", _on("customer", lambda t: scans.where(t, Binary("<", Name("c_mktsegment"), Literal("C")))), "SELECT * FROM customer WHERE c_mktsegment < 'C'")
_add("cmp_columns", _on("lineitem", lambda t: scans.where(t, Binary("<", Name("l_suppkey"), Binary("*", Name("l_linenumber"), Literal(10))))), "SELECT * FROM lineitem WHERE l_suppkey < l_linenumber * 10")
_add("cmp_float", _on("customer", lambda t: scans.where(t, Binary(">=", Name("c_acctbal"), Literal(5000)))), "SELECT * FROM customer WHERE c_acctbal >= 5000")


# joins
def _join(left: str, right: str, left_key: str, right_key: str, how: str, many: bool = False) -> Query:
    return lambda spark, sf_dir: joins.join(external(spark, sf_dir, left), external(spark, sf_dir, right), left_key, right_key, how, names=(left, right), separator="_", many=many)


_COLUMNS = {
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "nation": "n_nationkey n_name n_regionkey",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}


def _join_sql(left: str, right: str, left_key: str, right_key: str, how: str, where: str = "") -> str:
    picked = ", ".join(f"{a}.{c} AS {b}_{c}" for a, b, t in (("x", left, left), ("y", right if right != left else f"{left}_2", right)) for c in _COLUMNS[t].split())
    return f"SELECT {picked} FROM {left} x {how} JOIN {right} y ON x.{left_key} = y.{right_key} {where}"


_PN = ("part", "nation", "p_size", "n_nationkey")
for _how in joins.HOW:
    _add(f"join_{_how.lower()}", _join(*_PN, _how), _join_sql(*_PN, _how))
_add("join_many_to_many", _join("supplier", "customer", "s_nationkey", "c_nationkey", "INNER", many=True), _join_sql("supplier", "customer", "s_nationkey", "c_nationkey", "INNER"))
_add("join_self", _join("nation", "nation", "n_regionkey", "n_regionkey", "INNER"), _join_sql("nation", "nation", "n_regionkey", "n_regionkey", "INNER"))
_add("join_orders_lineitem_left", _join("orders", "lineitem", "o_orderkey", "l_orderkey", "LEFT"), _join_sql("orders", "lineitem", "o_orderkey", "l_orderkey", "LEFT"))
_add("join_customer_orders", _join("customer", "orders", "c_custkey", "o_custkey", "INNER"), _join_sql("customer", "orders", "c_custkey", "o_custkey", "INNER"))


def _filtered(how: str, column: Name, value) -> Query:
    return lambda spark, sf_dir: joins.where_joined(_join(*_PN, how)(spark, sf_dir), column, value, "part", "_")


_add("join_where_left", _filtered("LEFT", Name("p_size", "part"), 7), _join_sql(*_PN, "LEFT", "WHERE x.p_size = 7"))
_add("join_where_right", _filtered("LEFT", Name("n_name", "nation"), "FRANCE"), _join_sql(*_PN, "LEFT", "WHERE y.n_name = 'FRANCE'"))
_add("join_where_unqualified", _filtered("FULL", Name("p_size"), 3), _join_sql(*_PN, "FULL", "WHERE x.p_size = 3"))
_add("join_where_empty_text", _filtered("LEFT", Name("n_name", "nation"), ""), _join_sql(*_PN, "LEFT", "WHERE y.n_name = ''"))
_add("join_left_isnull", _filtered("LEFT", Name("n_name", "nation"), None), _join_sql(*_PN, "LEFT", "WHERE y.n_name IS NULL"))
_add("join_right_isnull", _filtered("RIGHT", Name("p_partkey", "part"), None), _join_sql(*_PN, "RIGHT", "WHERE x.p_partkey IS NULL"))
_add("join_full_isnull", _filtered("FULL", Name("n_name", "nation"), None), _join_sql(*_PN, "FULL", "WHERE y.n_name IS NULL"))

# changes, as the table after them
_SIZE, _TEN = Name("p_size"), Literal(10)
_REST = "p_partkey, p_name, p_brand, p_type"


def _update(changes: dict, condition=None) -> Query:
    return _on("part", lambda t: dml.update(t, changes, condition))


_add("update_all", _update({"p_brand": Literal("none")}), "SELECT p_partkey, p_name, 'none' AS p_brand, p_type, p_size, p_retailprice FROM part")
_add("update_where", _update({"p_brand": Literal("small")}, Binary("<", _SIZE, _TEN)), "SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN 'small' ELSE p_brand END AS p_brand, p_type, p_size, p_retailprice FROM part")
_add("update_expr", _update({"p_size": Binary("*", Binary("+", _SIZE, Literal(2)), Literal(3))}, Binary(">=", _SIZE, _TEN)), f"SELECT {_REST}, CAST(CASE WHEN p_size >= 10 THEN (p_size + 2) * 3 ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM part")
_add("update_precedence", _update({"p_size": Binary("-", Binary("+", Literal(2), Binary("*", Literal(3), _SIZE)), Literal(4))}), f"SELECT {_REST}, CAST(2 + 3 * p_size - 4 AS INTEGER) AS p_size, p_retailprice FROM part")
_add("update_multi_set", _update({"p_size": Binary("+", _SIZE, Literal(1)), "p_name": Name("p_brand"), "p_brand": Name("p_name")}, Binary("!=", _SIZE, _TEN)), "SELECT p_partkey, CASE WHEN p_size <> 10 THEN p_brand ELSE p_name END AS p_name, CASE WHEN p_size <> 10 THEN p_name ELSE p_brand END AS p_brand, p_type, CAST(CASE WHEN p_size <> 10 THEN p_size + 1 ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM part")
_add("update_pk", _update({"p_partkey": Binary("+", Name("p_partkey"), Literal(1_000_000))}, Binary("=", _SIZE, _TEN)), "SELECT CASE WHEN p_size = 10 THEN p_partkey + 1000000 ELSE p_partkey END AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
_add("update_int_div", _update({"p_size": Binary("/", Binary("-", _SIZE, Literal(25)), Literal(3))}), f"SELECT {_REST}, CAST((p_size - 25) // 3 AS INTEGER) AS p_size, p_retailprice FROM part")
_add("update_float", _update({"p_retailprice": Binary("/", Name("p_retailprice"), Literal(2))}, Binary(">", Name("p_retailprice"), Literal(1000))), f"SELECT {_REST}, p_size, CASE WHEN p_retailprice > 1000 THEN p_retailprice / 2 ELSE p_retailprice END AS p_retailprice FROM part")
_add("update_int_to_text", _update({"p_name": Binary("*", _SIZE, Literal(100_000))}), "SELECT p_partkey, CAST(p_size * 100000 AS VARCHAR) AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")
_add("delete_eq", _on("part", lambda t: dml.delete(t, Binary("=", _SIZE, _TEN))), "SELECT * FROM part WHERE NOT (p_size = 10)")
_add("delete_op", _on("part", lambda t: dml.delete(t, Binary(">", _SIZE, _TEN))), "SELECT * FROM part WHERE NOT (p_size > 10)")
_add("delete_all", _on("part", dml.delete), "SELECT * FROM part WHERE false")
_add("truncate", _on("part", dml.truncate), "SELECT * FROM part WHERE false")
_add("affected_rows", _on("part", lambda t: dml.affected(t, Binary("<=", _SIZE, _TEN))), "SELECT count(*) AS num_affected FROM part WHERE p_size <= 10")


@_query("insert_row", "SELECT * FROM nation UNION ALL SELECT CAST(99 AS INTEGER), 'ATLANTIS', CAST(3 AS INTEGER)")
def insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = external(spark, sf_dir, "nation")
    return dml.insert(nation, dml.values(spark, nation.schema, [[99, "ATLANTIS", 3]]))


# a join side that NULLs reach: padding deleted by an unknown condition must stay
@_query("delete_keeps_unknown", f"SELECT * FROM ({_join_sql(*_PN, 'LEFT')}) WHERE NOT coalesce(nation_n_regionkey = 1, false)")
def delete_keeps_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(_join(*_PN, "LEFT")(spark, sf_dir), Binary("=", Name("nation_n_regionkey"), Literal(1)))


# constraints
@_query("fk_violations", "SELECT * FROM part WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_size)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.orphans(external(spark, sf_dir, "part"), "p_size", external(spark, sf_dir, "nation"), "n_nationkey")


@_query("fk_clean", "SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def fk_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.orphans(external(spark, sf_dir, "orders"), "o_custkey", external(spark, sf_dir, "customer"), "c_custkey")


@_query("pk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicate_keys(external(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# whole sessions: the table after the statements
def _session(spark: SparkSession, sf_dir: str) -> Session:
    """A database with the parts as a stored table."""
    s = Session(spark, scratch_dir(spark))
    s.create_database("shop")
    s.use_database("shop")
    kinds = {"p_partkey": "INT", "p_name": "VARCHAR", "p_brand": "VARCHAR", "p_type": "VARCHAR", "p_size": "INT", "p_retailprice": "FLOAT"}
    s.create_table("part", [ColumnDef(c, kind, c == "p_partkey") for c, kind in kinds.items()])
    s.insert("part", external(spark, sf_dir, "part"))
    return s


#: As stored: FLOAT holds 32 bits and is shown with 64.
_PART = "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, CAST(CAST(p_retailprice AS REAL) AS DOUBLE) AS p_retailprice FROM part"
_NEW = "INSERT INTO part VALUES (-1, 'new', 'b', 't', 5, \"0.5\")"


@_query("txn_commit", f"SELECT p_partkey, p_name, p_brand, p_type, CAST(CASE WHEN p_size > 40 THEN p_size * 2 ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM ({_PART}) WHERE p_size >= 3 UNION ALL SELECT CAST(-1 AS INTEGER), 'new', 'b', 't', CAST(5 AS INTEGER), CAST(0.5 AS DOUBLE)")
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    for text in ("BEGIN", _NEW, "UPDATE part SET p_size = p_size * 2 WHERE p_size > 40", "DELETE FROM part WHERE p_size < 3", "COMMIT"):
        s.sql(text)
    return s.sql("SELECT * FROM part")


@_query("txn_rollback", _PART)
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    for text in ("BEGIN", _NEW, "UPDATE part SET p_size = 0", "TRUNCATE TABLE part", "DROP TABLE part", "ROLLBACK"):
        s.sql(text)
    return s.sql("SELECT * FROM part")


@_query("recovery", f"SELECT * FROM ({_PART}) WHERE p_size <> 7")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second session opens what the first committed; what it left open is gone."""
    s = _session(spark, sf_dir)
    s.sql("DELETE FROM part WHERE p_size = 7")
    s.sql("BEGIN")
    s.sql("TRUNCATE TABLE part")
    again = Session(spark, s.root)
    again.use_database("shop")
    return again.sql("SELECT * FROM part")


@_query("show_databases", "SELECT * FROM (VALUES ('other'), ('shop')) t(name)")
def show_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, scratch_dir(spark))
    s.sql("CREATE DATABASE shop")
    s.sql("CREATE DATABASE other")
    return s.sql("SHOW DATABASES")


@_query("session_join", "SELECT x.p_name AS part_p_name, n_name AS nation_n_name FROM part x FULL JOIN nation ON p_size = n_nationkey")
def session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    s.create_table("nation", [ColumnDef("n_nationkey", "INT", True), ColumnDef("n_name", "VARCHAR")])
    s.insert("nation", external(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    found = s.sql("SELECT part.p_name, nation.n_name FROM part FULL JOIN nation ON nation.n_nationkey = part.p_size")
    return found.toDF(*[c.replace(".", "_") for c in found.columns])


@_query("spark_select", "SELECT p_size, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 9 GROUP BY p_size")
def spark_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).sql("SELECT p_size, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 9 GROUP BY p_size")


@_query("spark_with", f"WITH s AS (SELECT p_size % 3 AS r, p_brand || '!' AS b FROM ({_PART})) SELECT r, b, count(*) AS n FROM s GROUP BY r, b")
def spark_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).sql("WITH s AS (SELECT `p_size` % 3 AS r, p_brand || '!' AS b FROM part) SELECT r, b, count(*) AS n FROM s GROUP BY r, b")


@_query("delete_key", f"SELECT * FROM ({_PART}) WHERE p_partkey <> 11")
def delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file is written anew, the others stay."""
    s = _session(spark, sf_dir)
    s.sql("DELETE FROM part WHERE p_partkey = 11")
    return s.table("part")


@_query("checkpoint", f"SELECT * FROM ({_PART}) UNION ALL SELECT CAST(-i AS INTEGER), 'new', 'b', 't', CAST(5 AS INTEGER), CAST(0.5 AS DOUBLE) FROM range(1, 4) r(i)")
def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts are gathered beside another writer's open transaction, which commits later."""
    s = _session(spark, sf_dir)
    s = Session(spark, s.root, compact_parts=2)
    s.use_database("shop")
    for i in (1, 2):
        s.sql(_NEW.replace("-1", f"-{i}"))
    s.checkpoint()
    other = Session(spark, s.root)
    other.use_database("shop")
    other.sql("BEGIN")
    other.sql(_NEW.replace("-1", "-3"))
    s.checkpoint()
    other.sql("COMMIT")
    s.use_database("shop")
    return s.table("part")


@_query("two_writers", f"SELECT * FROM ({_PART}) WHERE p_size <> 8")
def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two transactions from one state the first wins, the other changes nothing."""
    s = _session(spark, sf_dir)
    other = Session(spark, s.root)
    other.use_database("shop")
    for x, size in ((s, 8), (other, 9)):
        x.sql("BEGIN")
        x.sql(f"DELETE FROM part WHERE p_size = {size}")
    s.sql("COMMIT")
    try:
        other.sql("COMMIT")
    except EngineError:
        other.use_database("shop")
    return other.table("part")


@_query("fk_update", "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, CAST(CASE WHEN s_nationkey = 3 THEN 4 ELSE s_nationkey END AS INTEGER) AS s_nationkey FROM supplier")
def fk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference may be changed to a row that is there, not to one that isn't."""
    s = _session(spark, sf_dir)
    s.sql("CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR)")
    s.sql("CREATE TABLE supplier (s_suppkey INT PRIMARY KEY, s_nationkey INT, FOREIGN KEY (s_nationkey) REFERENCES nation (n_nationkey))")
    s.insert("nation", external(spark, sf_dir, "nation"))
    s.insert("supplier", external(spark, sf_dir, "supplier"))
    s.sql("UPDATE supplier SET s_nationkey = s_nationkey + 1 WHERE s_nationkey = 3")
    try:
        s.sql("UPDATE supplier SET s_nationkey = s_nationkey + 1000 WHERE s_nationkey = 5")
    except EngineError:
        pass
    return s.table("supplier")


@_query("insert_coerced", "SELECT * FROM (VALUES (CAST(-20 AS INTEGER), CAST(1000 AS DOUBLE), '7'), (CAST(3 AS INTEGER), CAST(0.5 AS DOUBLE), '1.5')) t(a, f, v)")
def insert_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that spells a number is one in a numeric column; what INT would cut short is refused."""
    s = Session(spark, scratch_dir(spark))
    s.create_database("d")
    s.use_database("d")
    s.sql("CREATE TABLE t (a INT, f FLOAT, v VARCHAR)")
    for text in ('"-020", 1e3, 7', '3, "0.5", 1.5', '"3.7", 1, "x"', '3.7, 1, "x"', '"word", 1, "x"'):
        try:
            s.sql(f"INSERT INTO t VALUES ({text})")
        except EngineError:
            pass
    return s.table("t")


@_query("console", "SELECT rpad('n_nationkey', 20, ' ') || ' | ' || rpad('n_name', 20, ' ') AS line UNION ALL SELECT repeat('-', 20) || '-+-' || repeat('-', 20) UNION ALL SELECT rpad(CAST(n_nationkey AS VARCHAR), 20, ' ') || ' | ' || rpad(n_name, 20, ' ') FROM nation")
def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as the shell prints it."""
    lines = render(scans.scan(external(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment with their orders: projection and filter pushed below the join."""
    customer = scans.scan(scans.equal(external(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING"), ["c_custkey", "c_name"])
    orders = scans.scan(external(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return joins.join(customer, orders, "c_custkey", "o_custkey", names=("customer", "orders"), separator="_")


_add("flagship", flagship, "SELECT c_custkey AS customer_c_custkey, c_name AS customer_c_name, o_orderkey AS orders_o_orderkey, o_custkey AS orders_o_custkey, o_totalprice AS orders_o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
