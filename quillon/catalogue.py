"""The engine's own queries, by name, and their SQL.

``SELECTS`` run through the dialect: parser, binder and planner. The others
call operators, tables or statistics. Double sums are rounded to cents on both
sides, as their last bits depend on the order of addition.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .cases import CASES
from .plans.parser import parse_statement
from .plans.planner import plan_string
from .plans.statistics import Statistics
from .session import Engine
from .sources.catalog import format_catalog, parse_catalog, Entry
from .sources.tables import Tables
from .sources.text import compose
from .types import DOUBLE, INTEGER, STRING

Query = Callable[[SparkSession, str], DataFrame]

#: Name: statement of the dialect, SQL, and whether ``sum`` is rounded to cents.
SELECTS: dict[str, tuple[str, str, bool]] = {
    "sf_eq": (
        "SELECT n.n_nationkey FROM nation AS n WHERE (n.n_name = 'NATION_9')",
        "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_9'",
        False,
    ),
    "sf_str_lt": (
        "SELECT r.r_regionkey, r.r_name FROM region AS r WHERE (r.r_name < 'EUROPE') AND (r.r_regionkey > 0)",
        "SELECT r_regionkey, r_name FROM region WHERE r_name < 'EUROPE' AND r_regionkey > 0",
        False,
    ),
    "sf_cnf_and": (
        "SELECT c.c_custkey, c.c_acctbal FROM customer AS c WHERE (c.c_nationkey = 23) AND (c.c_mktsegment = 'FURNITURE') AND (c.c_acctbal > 0.0) AND (c.c_acctbal < 9000.0)",
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 23 AND c_mktsegment = 'FURNITURE' AND c_acctbal > 0.0 AND c_acctbal < 9000.0",
        False,
    ),
    "sf_cnf_or": (
        "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_returnflag = 'R') AND (l.l_discount < 0.04 OR l.l_linestatus = 'F')",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04e0 OR l_linestatus = 'F')",
        False,
    ),
    "sf_att_att": (
        "SELECT n.n_nationkey, n.n_regionkey FROM nation AS n WHERE (n.n_nationkey = n.n_regionkey)",
        "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey = n_regionkey",
        False,
    ),
    "sf_lit_left": (
        "SELECT s.s_suppkey FROM supplier AS s WHERE (10 > s.s_suppkey)",
        "SELECT s_suppkey FROM supplier WHERE 10 > s_suppkey",
        False,
    ),
    "sf_dates": (
        "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_shipdate > '1997-01-01') AND (l.l_shipdate < '1997-01-04') AND (l.l_quantity > 10)",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-01-04' AND l_quantity > 10",
        False,
    ),
    "project": (
        "SELECT p.p_retailprice, p.p_name, p.p_partkey FROM part AS p WHERE (p.p_retailprice > 931.01) AND (p.p_retailprice < 931.3)",
        "SELECT p_retailprice, p_name, p_partkey FROM part WHERE p_retailprice > 931.01e0 AND p_retailprice < 931.3e0",
        False,
    ),
    "distinct": (
        "SELECT DISTINCT l.l_suppkey FROM lineitem AS l WHERE (l.l_quantity < 3.0)",
        "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity < 3.0",
        False,
    ),
    "distinct_multi": (
        "SELECT DISTINCT l.l_returnflag, l.l_linestatus FROM lineitem AS l WHERE (l.l_tax < 0.07)",
        "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_tax < 0.07e0",
        False,
    ),
    "sum_int": (
        "SELECT SUM (o.o_custkey - c.c_nationkey) FROM customer AS c, orders AS o WHERE (o.o_custkey = c.c_custkey) AND (c.c_mktsegment = 'FURNITURE')",
        "SELECT CAST(SUM(o.o_custkey - c.c_nationkey) AS BIGINT) AS sum FROM customer c, orders o WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment = 'FURNITURE'",
        False,
    ),
    "sum_dbl": (
        "SELECT SUM (s.s_acctbal + (s.s_acctbal * 1.05)) FROM supplier AS s WHERE (s.s_suppkey = s.s_suppkey)",
        "SELECT ROUND(SUM(s_acctbal + (s_acctbal * 1.05e0)), 2) AS sum FROM supplier",
        True,
    ),
    "sum_rassoc": (
        "SELECT SUM (l.l_extendedprice * 1 - l.l_discount) FROM lineitem AS l WHERE (l.l_orderkey = l.l_orderkey)",
        "SELECT ROUND(SUM(l_extendedprice * (1e0 - l_discount)), 2) AS sum FROM lineitem",
        True,
    ),
    "sum_rassoc_sub": (
        "SELECT SUM (p.p_size - p.p_partkey - p.p_size) FROM part AS p WHERE (p.p_size = p.p_size)",
        "SELECT CAST(SUM(p_size - (p_partkey - p_size)) AS BIGINT) AS sum FROM part",
        False,
    ),
    "sum_neg": (
        "SELECT SUM (- p.p_size) FROM part AS p WHERE (p.p_size > 40)",
        "SELECT CAST(SUM(-(p_size)) AS BIGINT) AS sum FROM part WHERE p_size > 40",
        False,
    ),
    "int_div": (
        "SELECT SUM (p.p_partkey / p.p_size) FROM part AS p WHERE (p.p_size > 0)",
        "SELECT CAST(SUM(CAST(TRUNC(CAST(p_partkey AS DOUBLE) / p_size) AS BIGINT)) AS BIGINT) AS sum FROM part",
        False,
    ),
    "sum_empty": (
        "SELECT SUM (p.p_size) FROM part AS p WHERE (p.p_size > 1000)",
        "SELECT CAST(SUM(p_size) AS BIGINT) AS sum FROM part WHERE p_size > 1000 HAVING COUNT(*) > 0",
        False,
    ),
    "sum_distinct": (
        "SELECT SUM DISTINCT (s.s_suppkey + c.c_nationkey), n.n_regionkey FROM nation AS n, supplier AS s, customer AS c WHERE (s.s_nationkey = n.n_nationkey) AND (c.c_nationkey = n.n_nationkey) AND (c.c_acctbal < 0.0) GROUP BY n.n_regionkey",
        "SELECT CAST(SUM(DISTINCT s.s_suppkey + c.c_nationkey) AS BIGINT) AS sum, n.n_regionkey FROM nation n, supplier s, customer c WHERE s.s_nationkey = n.n_nationkey AND c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0 GROUP BY n.n_regionkey",
        False,
    ),
    "sum_distinct_all": (
        "SELECT SUM DISTINCT (l.l_suppkey) FROM lineitem AS l WHERE (l.l_quantity < 3.0)",
        "SELECT CAST(SUM(DISTINCT l_suppkey) AS BIGINT) AS sum FROM lineitem WHERE l_quantity < 3.0",
        False,
    ),
    "groupby_join": (
        "SELECT SUM (o.o_orderkey), c.c_mktsegment FROM customer AS c, orders AS o WHERE (o.o_custkey = c.c_custkey) AND (o.o_orderstatus = 'F') GROUP BY c.c_mktsegment",
        "SELECT CAST(SUM(o.o_orderkey) AS BIGINT) AS sum, c.c_mktsegment FROM customer c, orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_mktsegment",
        False,
    ),
    "groupby_2key": (
        "SELECT SUM (l.l_extendedprice), l.l_returnflag, l.l_linestatus FROM lineitem AS l WHERE (l.l_orderkey = l.l_orderkey) GROUP BY l.l_returnflag, l.l_linestatus",
        "SELECT ROUND(SUM(l_extendedprice), 2) AS sum, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
        True,
    ),
    "groupby_3way": (
        "SELECT SUM (l.l_extendedprice * l.l_discount) FROM orders AS o, lineitem AS l, supplier AS s WHERE (o.o_orderkey = l.l_orderkey) AND (l.l_suppkey = s.s_suppkey) AND (o.o_orderstatus = 'O') AND (s.s_acctbal < 4000.0) GROUP BY s.s_suppkey",
        "SELECT ROUND(SUM(l.l_extendedprice * l.l_discount), 2) AS sum, s.s_suppkey FROM orders o, lineitem l, supplier s WHERE o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND o.o_orderstatus = 'O' AND s.s_acctbal < 4000 GROUP BY s.s_suppkey",
        True,
    ),
    "join_equi": (
        "SELECT o.o_orderkey, c.c_name FROM orders AS o, customer AS c WHERE (c.c_custkey = o.o_custkey) AND (o.o_totalprice > 200000.0)",
        "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
        False,
    ),
    "join_mn": (
        "SELECT s.s_suppkey, c.c_custkey FROM supplier AS s, customer AS c WHERE (s.s_nationkey = c.c_nationkey)",
        "SELECT s.s_suppkey, c.c_custkey FROM supplier s, customer c WHERE s.s_nationkey = c.c_nationkey",
        False,
    ),
    "join_multikey": (
        "SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem AS a, lineitem AS b WHERE (a.l_orderkey = b.l_orderkey) AND (a.l_partkey = b.l_partkey) AND (a.l_quantity > 49.0)",
        "SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_quantity > 49.0",
        False,
    ),
    "join_residual": (
        "SELECT o.o_orderkey, l.l_linenumber FROM orders AS o, lineitem AS l WHERE (o.o_orderkey = l.l_orderkey) AND (l.l_shipdate < o.o_orderdate)",
        "SELECT o.o_orderkey, l.l_linenumber FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND l.l_shipdate < o.o_orderdate",
        False,
    ),
    "join_theta": (
        "SELECT a.n_nationkey, b.n_nationkey FROM nation AS a, nation AS b WHERE (a.n_nationkey < b.n_nationkey)",
        "SELECT a.n_nationkey AS a_n_nationkey, b.n_nationkey AS b_n_nationkey FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey",
        False,
    ),
    "join_or": (
        "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey OR n.n_nationkey = r.r_regionkey)",
        "SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r WHERE (n.n_regionkey = r.r_regionkey OR n.n_nationkey = r.r_regionkey)",
        False,
    ),
    "join_cross": (
        "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n, region AS r WHERE (r.r_regionkey > 2)",
        "SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r WHERE r.r_regionkey > 2",
        False,
    ),
    "join_self_4": (
        "SELECT s.s_suppkey, c.c_custkey FROM supplier AS s, customer AS c, nation AS n1, nation AS n2 WHERE (s.s_nationkey = n1.n_nationkey) AND (c.c_nationkey = n2.n_nationkey) AND (n1.n_nationkey = n2.n_nationkey)",
        "SELECT s.s_suppkey, c.c_custkey FROM supplier s, customer c, nation n1, nation n2 WHERE s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND n1.n_nationkey = n2.n_nationkey",
        False,
    ),
    "join_5way": (
        "SELECT SUM (l.l_quantity) FROM customer AS c, orders AS o, lineitem AS l, part AS p, supplier AS s WHERE (c.c_custkey = o.o_custkey) AND (o.o_orderkey = l.l_orderkey) AND (p.p_partkey = l.l_partkey) AND (s.s_suppkey = l.l_suppkey) AND (p.p_size < 9) AND (c.c_mktsegment = 'BUILDING') GROUP BY s.s_nationkey",
        "SELECT ROUND(SUM(l.l_quantity), 2) AS sum, s.s_nationkey FROM customer c, orders o, lineitem l, part p, supplier s WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND p.p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND p.p_size < 9 AND c.c_mktsegment = 'BUILDING' GROUP BY s.s_nationkey",
        True,
    ),
}

#: The estimator's cases: relations with rows and distinct values, conditions applied to the
#: first so many relations, and the condition estimated over all.
ESTIMATES: dict[str, tuple[dict[str, tuple[int, dict[str, int]]], list[tuple[str, list[str]]], str, list[str]]] = {
    "e00": ({"supplier": (10_000, {"s_suppkey": 10_000}), "partsupp": (800_000, {"ps_suppkey": 10_000})}, [], "(s_suppkey = ps_suppkey)", ["supplier", "partsupp"]),
    "e01": ({"lineitem": (6_001_215, {"l_returnflag": 3, "l_discount": 11, "l_shipmode": 7})}, [], "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", ["lineitem"]),
    "e02": ({"orders": (1_500_000, {"o_custkey": 150_000}), "customer": (150_000, {"c_custkey": 150_000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})}, [("(c_custkey = o_custkey)", ["orders", "customer"])], "(c_nationkey = n_nationkey)", ["orders", "customer", "nation"]),
    "e03": ({"s": (10_000, {}), "c": (150_000, {"c.c_custkey": 150_000, "c.c_nationkey": 25}), "n1": (25, {"n1.n_nationkey": 25}), "n2": (25, {"n2.n_nationkey": 25})}, [("(s.s_nationkey = n1.n_nationkey)", ["s", "n1"]), ("(c.c_nationkey = n2.n_nationkey)", ["c", "n2"])], "(n1.n_nationkey = n2.n_nationkey)", ["c", "s", "n1", "n2"]),
    "e04": ({"part": (200_000, {"p.p_partkey": 200_000, "p.p_size": 50}), "partsupp": (800_000, {"ps.ps_suppkey": 10_000, "ps.ps_partkey": 200_000}), "supplier": (10_000, {"s.s_suppkey": 10_000, "s.s_nationkey": 25}), "nation": (25, {"n.n_nationkey": 25, "n.n_regionkey": 5}), "region": (5, {"r.r_regionkey": 5, "r.r_name": 5})}, [("(p.p_partkey = ps.ps_partkey) AND (p.p_size = 2)", ["part", "partsupp"]), ("(s.s_suppkey = ps.ps_suppkey)", ["part", "partsupp", "supplier"]), ("(s.s_nationkey = n.n_nationkey)", ["part", "partsupp", "supplier", "nation"])], "(n.n_regionkey = r.r_regionkey) AND (r.r_name = 'AMERICA')", ["part", "partsupp", "supplier", "nation", "region"]),
    "e05": ({"customer": (150_000, {"c_custkey": 150_000, "c_mktsegment": 5}), "orders": (1_500_000, {"o_orderkey": 1_500_000, "o_custkey": 150_000}), "lineitem": (6_001_215, {"l_orderkey": 1_500_000})}, [("(c_mktsegment = 'BUILDING') AND (c_custkey = o_custkey) AND (o_orderdate < '1995-03-1')", ["customer", "orders"])], "(l_orderkey = o_orderkey)", ["customer", "orders", "lineitem"]),
    "e06": ({"partsupp": (800_000, {"ps_suppkey": 10_000}), "supplier": (10_000, {"s_suppkey": 10_000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_name": 25})}, [("(s_suppkey = ps_suppkey)", ["partsupp", "supplier"])], "(s_nationkey = n_nationkey) AND (n_name = 'AMERICA')", ["partsupp", "supplier", "nation"]),
    "e07": ({"orders": (1_500_000, {"o_orderkey": 1_500_000}), "lineitem": (6_001_215, {"l_orderkey": 1_500_000})}, [], "(l_receiptdate > '1995-02-01') AND (l_orderkey = o_orderkey)", ["orders", "lineitem"]),
    "e08": ({"part": (200_000, {"p_partkey": 200_000, "p_size": 50}), "partsupp": (800_000, {"ps_partkey": 200_000})}, [], "(p_partkey = ps_partkey) AND (p_size = 3 OR p_size = 6 OR p_size = 19)", ["part", "partsupp"]),
    "e09": ({"part": (200_000, {"p_partkey": 200_000, "p_name": 199_996}), "partsupp": (800_000, {"ps_partkey": 200_000, "ps_suppkey": 10_000}), "supplier": (10_000, {"s_suppkey": 10_000})}, [("(p_partkey = ps_partkey) AND (p_name = 'dark green antique puff wheat')", ["part", "partsupp"])], "(s_suppkey = ps_suppkey)", ["part", "partsupp", "supplier"]),
    "e10": ({"customer": (150_000, {"c_custkey": 150_000, "c_nationkey": 25}), "orders": (1_500_000, {"o_orderkey": 1_500_000, "o_custkey": 150_000, "o_orderdate": -1}), "lineitem": (6_001_215, {"l_orderkey": 1_500_000}), "nation": (25, {"n_nationkey": 25})}, [("(c_custkey = o_custkey) AND (o_orderdate > '1994-01-23')", ["customer", "orders"]), ("(l_orderkey = o_orderkey)", ["customer", "orders", "lineitem"])], "(c_nationkey = n_nationkey)", ["customer", "orders", "lineitem", "nation"]),
    "e11": ({"part": (200_000, {"p_partkey": 200_000, "p_container": 40}), "lineitem": (6_001_215, {"l_partkey": 200_000, "l_shipinstruct": 4, "l_shipmode": 7})}, [], "(l_partkey = p_partkey) AND (l_shipmode = 'AIR' OR l_shipmode = 'AIR REG') AND (p_container = 'SM BOX' OR p_container = 'SM PACK') AND (l_shipinstruct = 'DELIVER IN PERSON')", ["part", "lineitem"]),
}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the Parquet tables of a folder."""
    return Engine(spark, views=lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in _TABLES else None)


def _select(name: str) -> Query:
    text, _, cents = SELECTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = engine(spark, sf_dir).query(text)
        return rows.withColumn("sum", F.round("sum", 2)) if cents else rows

    return run


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated(name: str) -> float:
    relations, applied, condition, over = ESTIMATES[name]
    statistics = Statistics()
    for relation, (rows, distinct) in relations.items():
        statistics.add_rel(relation, rows)
        for attribute, v in distinct.items():
            statistics.add_att(relation, attribute, v)
    for done, names in applied:
        statistics.apply(done, names)
    return statistics.estimate(condition, over)


def select_pipe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.select_pipe(_read(spark, sf_dir, "orders"), "(o_totalprice > 150000.0 OR o_orderstatus = 'F')")
    return op.project(op.select_pipe(rows, "(o_custkey < 100)"), ["o_orderkey", "o_custkey"])


def operator_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, join, group and sum by operators alone, without the language."""
    supplier = op.project(_read(spark, sf_dir, "supplier"), ["s_suppkey", "s_nationkey"])
    lineitem = op.select_pipe(_read(spark, sf_dir, "lineitem"), "(l_quantity > 25.0)")
    joined = op.join(supplier, lineitem, "(s_suppkey = l_suppkey)")
    return op.group_by(joined, ["s_nationkey"], "l_orderkey + l_linenumber")


def sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return op.positions(rows, ["o_totalprice", "o_custkey", "o_orderkey"]).select("o_orderkey", "pos")


def sorted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey")
    return op.ordered_union(op.select_pipe(orders, "(o_orderkey < 100)"), op.select_pipe(orders, "(o_orderkey < 50)"), ["o_orderkey"])


def _own_table(spark: SparkSession, label: str) -> tuple[Tables, str]:
    """A new table name; the table goes when the driver ends."""
    tables, name = Tables(spark), f"{label}_{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            tables.drop(name)
        except Exception:  # noqa: BLE001  the session may be gone
            return

    atexit.register(drop)
    return tables, name


def sorted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, name = _own_table(spark, "orders_sorted")
    tables.create(name, [("o_custkey", INTEGER), ("o_orderkey", INTEGER), ("o_totalprice", DOUBLE)], "sorted", ("o_custkey", "o_orderkey"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int"), F.col("o_orderkey").cast("int"), "o_totalprice")
    tables.add(name, rows)
    return tables.lookup(name, o_custkey=7)


def heap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into a heap keep both."""
    tables, name = _own_table(spark, "nation_heap")
    tables.create(name, [("n_nationkey", INTEGER), ("n_name", STRING)])
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tables.add(name, op.select_pipe(rows, "(n_nationkey < 10)"))
    tables.add(name, op.select_pipe(rows, "(n_nationkey > 5)"))
    return tables.scan(name)


def ddl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Engine(spark)
    _, name = _own_table(spark, "test")
    own.execute(f"CREATE TABLE {name} (day STRING, price DOUBLE, pieces INTEGER) AS HEAP")
    rows = _read(spark, sf_dir, "nation").orderBy("n_nationkey").limit(3).collect()
    own.tables.add(name, compose(spark, [f"{r.n_name}|{r.n_nationkey}.25|{r.n_regionkey}" for r in rows], own.tables.attributes(name)))
    return own.query(f"SELECT t.day, t.price, t.pieces FROM {name} AS t WHERE (t.day = t.day)")


def write_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.write_lines(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def stats_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = Statistics()
    statistics.collect("lineitem", _read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_discount"], exact=True)
    found = statistics.relations["lineitem"]
    return spark.createDataFrame([(int(found.rows), found.distinct["l_returnflag"], found.distinct["l_discount"])], "t long, v1 long, v2 long")


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, round(estimated(n), 2)) for n in ESTIMATES], "name string, rows double")


def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a catalog after writing and reading it."""
    entries = {"test": Entry("test", "test.tbl", (("a", INTEGER), ("b", DOUBLE), ("c", STRING)))}
    found = parse_catalog(format_catalog(entries))
    return spark.createDataFrame([(t, n, k) for t, e in found.items() for n, k in e.attributes], "tbl string, att string, kind string")


def explain_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ("project", "join_equi", "sum_int", "groupby_join", "sum_distinct")
    rows = [(n, plan_string(parse_statement(SELECTS[n][0]))) for n in chosen]
    return spark.createDataFrame(rows, "name string, plan string")


def cost_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-way join again, with the order of its tables chosen by statistics."""
    own = engine(spark, sf_dir)
    own.statistics = Statistics.tpch()
    return own.query(SELECTS["join_5way"][0]).withColumn("sum", F.round("sum", 2))


OTHERS: dict[str, tuple[Query, str]] = {
    "select_pipe": (
        select_pipe_query,
        "SELECT o_orderkey, o_custkey FROM orders WHERE (o_totalprice > 150000.0 OR o_orderstatus = 'F') AND o_custkey < 100",
    ),
    "operator_chain": (
        operator_chain,
        "SELECT CAST(SUM(l_orderkey + l_linenumber) AS BIGINT) AS sum, s_nationkey FROM supplier, lineitem WHERE s_suppkey = l_suppkey AND l_quantity > 25.0 GROUP BY s_nationkey",
    ),
    "sort_rank": (
        sort_rank,
        "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY o_totalprice, o_custkey, o_orderkey) AS BIGINT) AS pos FROM orders",
    ),
    "sorted_merge": (
        sorted_merge,
        "SELECT o_orderkey FROM orders WHERE o_orderkey < 100 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey < 50",
    ),
    "sorted_lookup": (
        sorted_lookup,
        "SELECT CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
    ),
    "heap_append": (
        heap_append,
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 5",
    ),
    "ddl_roundtrip": (ddl_roundtrip, "SELECT n_name AS day, n_nationkey + 0.25e0 AS price, n_regionkey AS pieces FROM nation ORDER BY n_nationkey LIMIT 3"),
    "write_text": (
        write_text,
        "SELECT concat('n_nationkey:[', CAST(n_nationkey AS VARCHAR), '], n_name:[', n_name, ']') AS line FROM nation",
    ),
    "stats_v": (stats_v, "SELECT COUNT(*) AS t, COUNT(DISTINCT l_returnflag) AS v1, COUNT(DISTINCT l_discount) AS v2 FROM lineitem"),
    "estimates": (
        estimates,
        "SELECT * FROM (VALUES ('e00', 800000e0), ('e01', 857316.43e0), ('e02', 1500000e0), ('e03', 60000000e0), ('e04', 3200e0), ('e05', 400081e0), ('e06', 32000e0), ('e07', 2000405e0), ('e08', 48000e0), ('e09', 4e0), ('e10', 2000405e0), ('e11', 21432.91e0)) t(name, rows)",
    ),
    "catalog_list": (catalog_list, "SELECT * FROM (VALUES ('test', 'a', 'INTEGER'), ('test', 'b', 'DOUBLE'), ('test', 'c', 'STRING')) t(tbl, att, kind)"),
    "explain_plans": (
        explain_plans,
        "SELECT * FROM (VALUES ('project', 'Project<-Select_File'), ('join_equi', 'Project<-Select_File<-Select_File<-Join'), ('sum_int', 'Sum<-Select_File<-Select_File<-Join'), ('groupby_join', 'Group_By<-Select_File<-Select_File<-Join'), ('sum_distinct', 'Group_By<-Duplicate_Elimination<-Select_File<-Select_File<-Join<-Select_File<-Join')) t(name, plan)",
    ),
    "cost_order": (cost_order, SELECTS["join_5way"][1]),
}


def queries() -> dict[str, Query]:
    return {name: _select(name) for name in SELECTS} | {name: query for name, (query, _) in (OTHERS | CASES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql, _) in SELECTS.items()} | {name: sql for name, (_, sql) in (OTHERS | CASES).items()}
