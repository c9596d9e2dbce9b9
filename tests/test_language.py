"""Lexer, parser, binder, expressions and plan strings."""

from __future__ import annotations

import pytest

from quillon.functions.arithmetic import arithmetic
from quillon.plans import ast
from quillon.plans.binder import BindError, Scope
from quillon.plans.parser import ParseError, parse_cnf, parse_expression, parse_sort_keys, parse_statement, tokens
from quillon.session import Engine


def test_tokens_keep_hyphens_and_signs():
    assert tokens("a-b") == [("name", "a-b")]
    assert tokens("a -5") == [("name", "a"), ("int", "-5")]
    assert tokens("a - 5.") == [("name", "a"), ("sign", "-"), ("float", "5.")]
    assert tokens(r"'it\'s'") == [("string", "it's")]
    assert tokens("select SELECT") == [("name", "select"), ("keyword", "SELECT")]


@pytest.mark.parametrize("text", ["SELECT a FROM t AS t WHERE (a = 1);", "SELECT a FROM t AS t", "SELECT a FROM t WHERE (a = a)", "SELECT a FROM t AS t WHERE a = a", "DROP t", "a -5", ""])
def test_refused(text):
    with pytest.raises(ParseError):
        parse_statement(text)


def test_arithmetic_is_right_associative_without_precedence():
    assert str(parse_expression("a - b - c")) == "(a - (b - c))"
    assert str(parse_expression("a * b + c")) == "(a * (b + c))"
    assert str(parse_expression("- a + b")) == "(- (a + b))"
    assert str(parse_expression("(a - b) - c")) == "((a - b) - c)"
    with pytest.raises(ParseError):
        parse_expression("t.a + 1")


def test_statements():
    assert parse_statement("CREATE TABLE t (a INTEGER, b STRING) AS SORTED ON b, a") == ast.Create("t", (("a", "INTEGER"), ("b", "STRING")), "sorted", ("b", "a"))
    assert parse_statement("INSERT 'x.tbl' INTO t") == ast.Insert("x.tbl", "t")
    assert parse_statement("SET OUTPUT NONE") == ast.SetOutput("NONE", False)
    assert parse_statement("EXIT") == ast.Exit()
    select = parse_statement("SELECT SUM DISTINCT (a.x * 2), a.y FROM t AS a WHERE (a.x > -1 OR 'q' = a.y) AND (a.x = a.x) GROUP BY a.y")
    assert select.sum.distinct and [len(g) for g in select.where.groups] == [2, 1]


def test_sort_keys_and_bare_conditions():
    assert parse_sort_keys("(a) AND (b)") == ["a", "b"]
    assert parse_cnf("(a)") == parse_cnf("(a = a)")
    with pytest.raises(ParseError):
        parse_sort_keys("(a > b)")


@pytest.fixture(scope="module")
def engine(spark):
    left = spark.createDataFrame([(1, 1.5, "x"), (1, 2.5, "y"), (2, 3.5, "x")], "k int, v double, s string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, t string")
    return Engine(spark, views={"l": left, "r": right})


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_integer_arithmetic(spark):
    frame = spark.createDataFrame([(-7, 2, 2_000_000_000)], "a int, b int, c int")
    scope = Scope([frame])

    def value(text):
        return frame.select(arithmetic(parse_expression(text), scope)[0]).first()[0]

    assert value("a / b") == -3  # truncates
    assert value("c + c") == 4_000_000_000  # does not wrap
    assert value("a / 2.0") == -3.5
    with pytest.raises(BindError):
        arithmetic(parse_expression("s + 1"), Scope([spark.createDataFrame([("x",)], "s string")]))


def test_joins_keep_all_matches(engine):
    """Repeated keys on both sides, and predicates beside the equality."""
    assert rows(engine.query("SELECT a.v, b.t FROM l AS a, r AS b WHERE (a.k = b.k)")) == [(1.5, "p"), (1.5, "q"), (2.5, "p"), (2.5, "q")]
    assert rows(engine.query("SELECT a.v, b.t FROM l AS a, r AS b WHERE (a.k = b.k) AND (a.v > 2) AND (b.t = 'q' OR a.s = 'z')")) == [(2.5, "q")]
    assert len(rows(engine.query("SELECT a.v, b.t FROM l AS a, r AS b WHERE (a.k = b.k OR b.t = 'r')"))) == 7
    assert len(rows(engine.query("SELECT a.v, b.v FROM l AS a, l AS b WHERE (a.v < b.v)"))) == 3
    assert engine.query("SELECT a.k, b.k, b.t FROM l AS a, r AS b WHERE (a.k = b.k)").columns == ["a_k", "b_k", "t"]


def test_sums(engine):
    assert rows(engine.query("SELECT SUM (a.v) FROM l AS a WHERE (a.k = a.k)")) == [(7.5,)]
    assert rows(engine.query("SELECT SUM (a.v) FROM l AS a WHERE (a.k > 9)")) == []
    assert rows(engine.query("SELECT SUM DISTINCT (a.k) FROM l AS a WHERE (a.k = a.k)")) == [(3,)]
    grouped = engine.query("SELECT SUM (a.v), a.k FROM l AS a WHERE (a.k = a.k) GROUP BY a.k")
    assert grouped.columns == ["sum", "k"] and rows(grouped) == [(3.5, 2), (4.0, 1)]
    assert rows(engine.query("SELECT SUM (a.k) FROM l AS a WHERE (a.k > 9) GROUP BY a.s")) == []
    assert rows(engine.query("SELECT DISTINCT a.s FROM l AS a WHERE (a.k = a.k)")) == [("x",), ("y",)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.nope FROM l AS a WHERE (a.k = a.k)",
        "SELECT k FROM l AS a, r AS b WHERE (a.k = b.k)",
        "SELECT a.k FROM l AS a WHERE (a.s > 3)",
        "SELECT SUM (a.s) FROM l AS a WHERE (a.k = a.k)",
        "SELECT SUM (a.v), a.s FROM l AS a WHERE (a.k = a.k)",
        "SELECT SUM (a.v), a.s FROM l AS a WHERE (a.k = a.k) GROUP BY a.k",
        "SELECT a.k FROM l AS a WHERE (a.k = a.k) GROUP BY a.k",
        "SELECT a.k FROM l AS a, r AS a WHERE (a.k = a.k)",
        "SELECT a.k FROM nowhere AS a WHERE (a.k = a.k)",
    ],
)
def test_errors_of_binding(engine, text):
    with pytest.raises(ValueError):
        engine.query(text)


def test_strict_types(engine, spark):
    strict = Engine(spark, views=engine.views, strict_types=True)
    with pytest.raises(BindError):
        strict.query("SELECT a.v FROM l AS a WHERE (a.v > 1)")
    assert len(rows(strict.query("SELECT a.v FROM l AS a WHERE (a.v > 1.0)"))) == 3


def test_plans_are_pushed_down(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "id * 2 as v", "'x' as unused").write.parquet(str(tmp_path / "t"))
    own = Engine(spark, views={"t": spark.read.parquet(str(tmp_path / "t"))})
    shown = own.explain("SELECT a.v FROM t AS a, t AS b WHERE (a.k = b.k) AND (a.k > 90)")
    assert "Project<-Select_File<-Select_File<-Join" in shown
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,90)]" in shown
    assert "unused" not in shown and "Cartesian" not in shown and "NestedLoop" not in shown
