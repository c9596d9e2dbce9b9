"""Queries of statements, tables, files and orders, each with its SQL.

They go through what a user calls: statements of the language, files that are
written and read back, tables of the catalog. Order is made visible as the
column ``pos``. Each works in a folder and tables of its own.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .plans.binder import BindError
from .plans.parser import parse_cnf, parse_statement
from .plans.planner import plan_tree
from .plans.statistics import Statistics
from .session import Engine, display
from .sources import files
from .sources.catalog import read_catalog
from .types import parse_type

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession) -> str:
    path = f"{files.shared_dir(spark)}/quillon/cases-{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            files.remove(path)
        except Exception:  # noqa: BLE001  the session may be gone
            return

    atexit.register(gone)
    return path


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_file(rows: DataFrame, path: str) -> str:
    """The rows as a text table, a field after the other with ``|`` behind."""
    fields = [F.concat(F.col(c).cast("string"), F.lit("|")) for c in rows.columns]
    rows.select(F.concat(*fields)).write.text(path)
    return path


def _loaded(spark: SparkSession, sf_dir: str, kind: str, times: int = 1) -> tuple[Engine, str]:
    """Suppliers by CREATE TABLE and INSERT from a text file."""
    folder, name = _folder(spark), _name("supplier")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    _text_file(rows, f"{folder}/supplier.tbl")
    engine = Engine(spark, data_dir=folder, home=f"{folder}/home")
    engine.execute(f"CREATE TABLE {name} (s_suppkey INTEGER, s_name STRING, s_nationkey INTEGER, s_acctbal DOUBLE) AS {kind}")
    for _ in range(times):
        engine.execute(f"INSERT 'supplier.tbl' INTO {name}")
    return engine, name


def insert_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, name = _loaded(spark, sf_dir, "HEAP", 2)
    return engine.query(f"SELECT s.s_suppkey, s.s_name, s.s_acctbal FROM {name} AS s WHERE (s.s_nationkey < 9)")


def sorted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, name = _loaded(spark, sf_dir, "SORTED ON s_nationkey, s_suppkey")
    return op.numbered(engine.tables.scan(name)).select("s_suppkey", "s_nationkey", "pos")


def sorted_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine loads: eight runs are merged into one table, the last is beside it."""
    engine, name = _loaded(spark, sf_dir, "SORTED ON s_suppkey")
    rows = spark.table(name)
    for least in range(0, 40, 5):
        part = op.select_pipe(_read(spark, sf_dir, "supplier"), f"(s_suppkey < {least})")
        engine.tables.add(name, part.select([F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))
    return op.numbered(engine.tables.scan(name)).select("s_suppkey", "pos")


def sorted_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, name = _loaded(spark, sf_dir, "SORTED ON s_nationkey, s_suppkey")
    return engine.tables.lookup(name, s_nationkey=3).select("s_suppkey", "s_name")


def sorted_other_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By an attribute that is no prefix of the keys: the whole table is filtered."""
    engine, name = _loaded(spark, sf_dir, "SORTED ON s_nationkey, s_suppkey")
    return engine.query(f"SELECT s.s_suppkey, s.s_nationkey FROM {name} AS s WHERE (s.s_suppkey = 17 OR s.s_acctbal < 0.0)")


def dropped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After DROP a name is free again: no row of the first table is in the second."""
    engine, name = _loaded(spark, sf_dir, "HEAP")
    engine.execute(f"DROP TABLE {name}")
    _text_file(_read(spark, sf_dir, "region").select("r_regionkey", "r_name"), f"{engine.data_dir}/region.tbl")
    engine.execute(f"CREATE TABLE {name} (r_regionkey INTEGER, r_name STRING) AS HEAP")
    engine.execute(f"INSERT 'region.tbl' INTO {name}")
    return engine.query(f"SELECT r.r_regionkey, r.r_name FROM {name} AS r WHERE (r.r_name = r.r_name)")


def output_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET OUTPUT to a file, a SELECT, and the file's lines."""
    engine, name = _loaded(spark, sf_dir, "HEAP")
    engine.execute(f"SET OUTPUT '{engine.data_dir}/out'")
    engine.execute(f"SELECT s.s_suppkey, s.s_name, s.s_acctbal FROM {name} AS s WHERE (s.s_acctbal > 1000.0)")
    return spark.read.text(f"{engine.data_dir}/out").withColumnRenamed("value", "line")


def printed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, name = _loaded(spark, sf_dir, "SORTED ON s_suppkey")
    shown = display(engine.execute(f"SELECT s.s_suppkey, s.s_name, s.s_nationkey FROM {name} AS s WHERE (s.s_nationkey < 5)").rows)
    return spark.createDataFrame([(line,) for line in shown.split("\n")], "line string")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement says, a table's name being T."""
    engine, name = Engine(spark), _name("t")
    texts = [f"CREATE TABLE {name} (a INTEGER) AS SORTED ON a", "SET OUTPUT NONE", "SET OUTPUT STDOUT", f"DROP TABLE {name}", "EXIT"]
    results = [engine.execute(t) for t in texts]
    rows = [(k, r.text.replace(name, "T"), r.goes_on) for k, r in enumerate(results)]
    return spark.createDataFrame(rows, "n int, said string, goes_on boolean")


REFUSED = {
    "attribute beside a sum": "SELECT SUM (n.n_nationkey), n.n_name FROM nation AS n WHERE (n.n_nationkey > 1)",
    "unknown attribute": "SELECT n.n_name FROM nation AS n WHERE (n.n_size > 1)",
    "ambiguous attribute": "SELECT a.n_name FROM nation AS a, nation AS b WHERE (n_nationkey > 1)",
    "unknown type": "CREATE TABLE x (a DATE) AS HEAP",
    "unknown table": "DROP TABLE nowhere_at_all",
    "no condition": "SELECT n.n_name FROM nation AS n",
}


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the language, and a run length below 1."""
    engine, found = Engine(spark, lambda n: _read(spark, sf_dir, n) if n == "nation" else None), []

    def tried(what: str, run: Callable[[], object]) -> None:
        try:
            run()
        except (BindError, ValueError):
            found.append((what, True))
        else:
            found.append((what, False))

    for what, text in REFUSED.items():
        tried(what, lambda text=text: engine.execute(text))
    tried("run length", lambda: op.sort(_read(spark, sf_dir, "nation"), ["n_name"], run_length=0))
    return spark.createDataFrame(found, "what string, refused boolean")


def statistics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tables and of an alias, after writing and reading them."""
    statistics, path = Statistics(), f"{_folder(spark)}/statistics"
    statistics.collect("nation", _read(spark, sf_dir, "nation"), ["n_nationkey", "n_regionkey"], exact=True)
    statistics.collect("orders", _read(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"], exact=True)
    statistics.copy_rel("nation", "n")
    statistics.write(path)
    rows = [(n, a, int(r.rows), v) for n, r in Statistics.read(path).relations.items() for a, v in r.distinct.items()]
    return spark.createDataFrame(rows, "rel string, att string, t long, v long")


def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog file after a CREATE for each of two tables, and a DROP."""
    home, own = f"{_folder(spark)}/home", uuid.uuid4().hex[:8]
    engine = Engine(spark, home=home)
    spelled = {"int": "INTEGER", "bigint": "INTEGER", "double": "DOUBLE", "string": "STRING"}
    for table in ("nation", "supplier", "region"):
        attributes = ", ".join(f"{n} {spelled[t]}" for n, t in _read(spark, sf_dir, table).dtypes)
        engine.execute(f"CREATE TABLE {table}_{own} ({attributes}) AS HEAP")
    engine.execute(f"DROP TABLE region_{own}")
    entries = read_catalog(f"{home}/catalog")
    rows = [(t.removesuffix(f"_{own}"), n, parse_type(k)) for t, e in entries.items() for n, k in e.attributes]
    return spark.createDataFrame(rows, "tbl string, att string, kind string")


def reopened_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second session finds a table of the first by its home folder, though Spark's catalog has forgotten it."""
    engine, name = _loaded(spark, sf_dir, "SORTED ON s_nationkey")
    spark.sql(f"DROP TABLE {name}")
    again = Engine(spark, data_dir=engine.data_dir, home=engine.home)
    again.execute(f"INSERT 'supplier.tbl' INTO {name}")
    assert again.tables.sort_keys(name) == ("s_nationkey",)
    return again.query(f"SELECT SUM (s.s_suppkey), s.s_nationkey FROM {name} AS s WHERE (s.s_suppkey > 4) GROUP BY s.s_nationkey")


def bare_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys stated as conditions of one operand."""
    rows = op.sort(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "(c_mktsegment) AND (c_nationkey) AND (c_custkey)")
    return op.numbered(rows).select("c_custkey", "pos")


def sort_all_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers first, then doubles, then strings."""
    rows = _read(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_size", "p_name", "p_partkey")
    return op.numbered(op.sort_all(rows.select("p_brand", "p_retailprice", "p_size", "p_name"))).groupBy("p_brand").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("pos").alias("all_pos")
    )


def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours out of order, in sorted rows."""
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return op.order_violations(op.sort(rows, ["l_suppkey", "l_extendedprice"]), ["l_suppkey", "l_extendedprice"])


def printed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions made from rows, parsed and printed again."""
    rows = _read(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # 25 rows at any scale
    shown = [(str(parse_cnf(f"( n.n_name='{r[0]}' OR n.n_nationkey  <{r[1]}) AND ({r[1]} = n.n_nationkey)")),) for r in rows]
    return spark.createDataFrame(shown, "shown string")


def plan_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators of a statement with their attributes and conditions, a line each."""
    text = "SELECT SUM (o.o_orderkey), c.c_mktsegment FROM customer AS c, orders AS o WHERE (c.c_custkey = o.o_custkey) AND (o.o_totalprice > 90000.5) GROUP BY c.c_mktsegment"
    engine, select = Engine(spark, lambda n: _read(spark, sf_dir, n)), parse_statement(text)
    frames = {a: _read(spark, sf_dir, t).select([F.col(c).alias(f"{a}.{c}") for c in _read(spark, sf_dir, t).columns]) for t, a in select.tables}
    return spark.createDataFrame([(line,) for line in plan_tree(select, frames, engine.query(text)).split("\n")], "line string")


_TYPES = "CASE column_type WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'VARCHAR' THEN 'STRING' ELSE 'INTEGER' END"

CASES: dict[str, tuple[Query, str]] = {
    "insert_heap": (
        insert_heap,
        "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal FROM supplier, (VALUES (1), (2)) t(n) WHERE s_nationkey < 9",
    ),
    "sorted_scan": (
        sorted_scan,
        "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS pos FROM supplier",
    ),
    "sorted_table_merge": (
        sorted_table_merge,
        "WITH t AS (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier, (VALUES (0), (5), (10), (15), (20), (25), (30), (35)) v(n) WHERE s_suppkey < n) "
        "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS pos FROM t",
    ),
    "sorted_prefix_lookup": (sorted_prefix_lookup, "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name FROM supplier WHERE s_nationkey = 3"),
    "sorted_other_lookup": (
        sorted_other_lookup,
        "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_nationkey FROM supplier WHERE s_suppkey = 17 OR s_acctbal < 0",
    ),
    "dropped_table": (dropped_table, "SELECT r_regionkey, r_name FROM region"),
    "output_file": (
        output_file,
        "SELECT 's_suppkey:[' || s_suppkey || '], s_name:[' || s_name || '], s_acctbal:[' || printf('%.6f', s_acctbal) || ']' AS line FROM supplier WHERE s_acctbal > 1000",
    ),
    "printed_rows": (
        printed_rows,
        "SELECT 's_suppkey: [' || s_suppkey || '], s_name: [' || s_name || '], s_nationkey: [' || s_nationkey || ']' AS line FROM supplier WHERE s_nationkey < 5 "
        "UNION ALL SELECT 'Query Result :' UNION ALL SELECT 'Total records: ' || count(*) FROM supplier WHERE s_nationkey < 5",
    ),
    "statements": (
        statements,
        "SELECT * FROM (VALUES (0, 'Created T', true), (1, 'Output NONE', true), (2, 'Output STDOUT', true), (3, 'Dropped T', true), (4, '', false)) t(n, said, goes_on)",
    ),
    "refused": (refused, "SELECT what, true AS refused FROM (VALUES " + ", ".join(f"('{w}')" for w in [*REFUSED, "run length"]) + ") t(what)"),
    "statistics_file": (
        statistics_file,
        "WITH c AS (SELECT 'nation' AS rel, 'n_nationkey' AS att, count(*) AS t, count(DISTINCT n_nationkey) AS v FROM nation UNION ALL "
        "SELECT 'nation', 'n_regionkey', count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL "
        "SELECT 'orders', 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL "
        "SELECT 'orders', 'o_custkey', count(*), count(DISTINCT o_custkey) FROM orders) "
        "SELECT * FROM c UNION ALL SELECT 'n', 'n.' || att, t, v FROM c WHERE rel = 'nation'",
    ),
    "catalog_file": (
        catalog_file,
        f"SELECT 'nation' AS tbl, column_name AS att, {_TYPES} AS kind FROM (DESCRIBE nation) UNION ALL SELECT 'supplier', column_name, {_TYPES} FROM (DESCRIBE supplier)",
    ),
    "reopened_tables": (
        reopened_tables,
        "SELECT CAST(2 * SUM(s_suppkey) AS BIGINT) AS sum, s_nationkey FROM supplier WHERE s_suppkey > 4 GROUP BY s_nationkey",
    ),
    "bare_sort_keys": (bare_sort_keys, "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey) AS pos FROM customer"),
    "sort_all_attributes": (
        sort_all_attributes,
        "WITH s AS (SELECT p_brand, row_number() OVER (ORDER BY p_size, p_retailprice, p_brand, p_name) AS pos FROM part) "
        "SELECT p_brand, min(pos) AS first, max(pos) AS last, CAST(sum(pos) AS BIGINT) AS all_pos FROM s GROUP BY p_brand",
    ),
    "order_check": (
        order_check,
        "WITH s AS (SELECT l_suppkey AS a, l_extendedprice AS b, lead(l_suppkey) OVER w AS c, lead(l_extendedprice) OVER w AS d FROM lineitem WINDOW w AS (ORDER BY l_suppkey, l_extendedprice)) "
        "SELECT count(*) AS n FROM s WHERE a > c OR (a = c AND b > d)",
    ),
    "printed_conditions": (
        printed_conditions,
        "SELECT '(n.n_name = ''' || n_name || ''' OR n.n_nationkey < ' || n_nationkey || ') AND (' || n_nationkey || ' = n.n_nationkey)' AS shown FROM nation",
    ),
    "plan_trees": (
        plan_trees,
        "SELECT * FROM (VALUES ('#1 Select_File customer AS c'), ('    attributes: c.c_custkey bigint, c.c_mktsegment string'), ('#2 Select_File orders AS o'), "
        "('    attributes: o.o_orderkey bigint, o.o_custkey bigint, o.o_totalprice double'), ('    where: (o.o_totalprice > 90000.5)'), ('#3 Join #1, #2'), "
        "('    attributes: c.c_custkey bigint, c.c_mktsegment string, o.o_orderkey bigint, o.o_custkey bigint, o.o_totalprice double'), "
        "('    where: (c.c_custkey = o.o_custkey)'), ('#4 Group_By #3 by c.c_mktsegment of o.o_orderkey'), ('    attributes: sum bigint, c_mktsegment string')) t(line)",
    ),
}
