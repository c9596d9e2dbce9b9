"""Operators, text, catalogs, tables, statistics and the session."""

from __future__ import annotations

import io
import sys

import pytest

from quillon import catalogue, session
from quillon import operators as op
from quillon.plans.statistics import Statistics
from quillon.session import Engine, display
from quillon.sources.catalog import format_catalog, parse_catalog, read_catalog, write_catalog
from quillon.sources.tables import Tables
from quillon.sources.text import compose, read_text
from quillon.streaming import windowed_sum
from quillon.types import DOUBLE, INTEGER, STRING, parse_type

ATTRIBUTES = [("a", INTEGER), ("b", DOUBLE), ("c", STRING)]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_text_with_and_without_last_separator(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|10.1|first\n2|20.2|second|\n\n")
    assert rows(read_text(spark, str(tmp_path / "t.tbl"), ATTRIBUTES)) == [(1, 10.1, "first"), (2, 20.2, "second")]


def test_bad_numbers(spark):
    line = ["x|y|z", "3"]
    assert rows(compose(spark, line, ATTRIBUTES)) == [(0, 0.0, "z"), (3, 0.0, "")]
    assert compose(spark, line[:1], ATTRIBUTES, "null").first()[0] is None
    with pytest.raises(Exception, match="not a number"):
        compose(spark, line, ATTRIBUTES, "fail").collect()
    with pytest.raises(ValueError):
        compose(spark, line, ATTRIBUTES, "maybe")


def test_catalog(tmp_path):
    text = "BEGIN\nt\nt.tbl\na Int\nb Double\nc String\nEND\n"
    entries = parse_catalog(text)
    assert entries["t"].attributes == tuple(ATTRIBUTES) and format_catalog(entries) == text
    write_catalog(entries, str(tmp_path / "catalog"))
    assert read_catalog(str(tmp_path / "catalog")) == entries
    for bad in ("t", "BEGIN t t.tbl a Int", "BEGIN t t.tbl a Date END"):
        with pytest.raises(ValueError):
            parse_catalog(bad)
    with pytest.raises(ValueError):
        parse_type("DATE")


def test_heap_appends_and_sorted_merges(spark):
    tables = Tables(spark)
    for name in ("heap_t", "sorted_t"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.create("heap_t", ATTRIBUTES)
    tables.create("sorted_t", ATTRIBUTES, "sorted", ("c", "a"))
    for lines in (["2|1.0|b", "1|1.0|b"], ["3|1.0|a", "1|1.0|b"]):
        for name in ("heap_t", "sorted_t"):
            tables.add(name, compose(spark, lines, ATTRIBUTES))
    assert len(rows(tables.scan("heap_t"))) == 4
    assert [tuple(r)[::2] for r in tables.scan("sorted_t").collect()] == [(3, "a"), (1, "b"), (1, "b"), (2, "b")]
    assert len(rows(tables.lookup("sorted_t", c="b", a=1))) == 2
    assert tables.kind("sorted_t") == "sorted" and tables.sort_keys("sorted_t") == ("c", "a")
    for wrong in (("heap_t", ATTRIBUTES, "heap", ()), ("x", ATTRIBUTES, "tree", ()), ("x", ATTRIBUTES, "sorted", ()), ("x", ATTRIBUTES, "sorted", ("z",)), ("x", ATTRIBUTES * 2, "heap", ())):
        with pytest.raises(ValueError):
            tables.create(*wrong)
    tables.drop("heap_t")
    tables.drop("sorted_t")
    with pytest.raises(ValueError):
        tables.drop("heap_t")


def test_session(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1|10.1|first\n2|20.2|second\n")
    spark.sql("DROP TABLE IF EXISTS people")
    engine = Engine(spark, data_dir=str(tmp_path), statistics=Statistics())
    engine.execute("CREATE TABLE people (a INTEGER, b DOUBLE, c STRING) AS HEAP")
    engine.execute("INSERT 'in.txt' INTO people")
    select = "SELECT p.b, p.c FROM people AS p WHERE (p.a > 1)"
    assert display(engine.execute(select).rows) == "Query Result :\nb: [20.2], c: [second]\nTotal records: 1"
    engine.execute("SET OUTPUT NONE")
    assert engine.execute(select).text.startswith("Project<-Select_File")
    engine.execute(f"SET OUTPUT '{tmp_path}/out'")
    assert engine.execute(select).text == "Total records: 1"
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["b:[20.200000], c:[second]"]
    with pytest.raises(ValueError):
        engine.execute("SET OUTPUT ELSEWHERE")
    engine.execute("DROP TABLE people")
    assert not engine.statistics.has("people") and not engine.execute("EXIT").goes_on


def test_command_line(spark, monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", io.StringIO("\nnonsense\nSET OUTPUT STDOUT\nEXIT\nnever\n"))
    session.main([])
    shown = capsys.readouterr().out
    assert "error:" in shown and "Output STDOUT" in shown and "never" not in shown


def test_operators(spark):
    frame = spark.createDataFrame([(2, 1.5, "b"), (1, 2.5, "b"), (1, 2.5, "a")], "k int, v double, s string")
    assert op.project(frame, [2, "k"]).columns == ["s", "k"]
    assert [tuple(r) for r in op.sort(frame, "(s) AND (k)").collect()] == [(1, 2.5, "a"), (1, 2.5, "b"), (2, 1.5, "b")]
    assert [tuple(r) for r in op.sort_all(frame).collect()] == [(1, 2.5, "a"), (1, 2.5, "b"), (2, 1.5, "b")]
    with pytest.raises(ValueError):
        op.sort(frame, ["k"], run_length=0)
    assert len(rows(op.join(frame, frame.withColumnsRenamed({"k": "k2", "v": "v2", "s": "s2"})))) == 9
    assert rows(op.duplicate_removal(frame.limit(1))) == [(2, 1.5, "b")]
    assert rows(op.sum_(frame, "v * 2")) == [(13.0,)] and rows(op.sum_(frame.filter("k > 5"), "v")) == []
    assert rows(op.group_by(frame, ["s"], "k")) == [(1, "a"), (3, "b")]
    assert len(op.ordered_union(frame, frame, ["k"]).collect()) == 6


def test_positions_number_all_rows(spark):
    frame = spark.range(500).selectExpr("id", "id % 7 as k")
    found = {r.id: r.pos for r in op.positions(frame, ["k", "id"], buckets=5).collect()}
    assert [i for i, _ in sorted(found.items(), key=lambda x: x[1])] == sorted(found, key=lambda i: (i % 7, i))
    assert sorted(found.values()) == list(range(1, 501))
    assert op.positions(frame.filter("id < 0"), ["k"]).count() == 0


@pytest.mark.parametrize(
    ("name", "value", "within"),
    [("e00", 800000, 0), ("e01", 857316.43, 1), ("e02", 1500000, 0.1), ("e03", 60000000, 0.1), ("e04", 3200, 0.1), ("e05", 400081, 0.1), ("e06", 32000, 0.1), ("e07", 2000405, 0.1), ("e08", 48000, 0.1), ("e09", 4, 0.5), ("e10", 2000405, 0.1), ("e11", 21432.9, 0.5)],
)
def test_estimates(name, value, within):
    assert abs(catalogue.estimated(name) - value) <= within


def test_statistics_files_and_rules(spark, tmp_path):
    s = Statistics()
    s.add_rel("supplier", 10_000)
    s.add_att("supplier", "s_suppkey", -1)
    s.add_rel("partsupp", 800_000)
    s.add_att("partsupp", "ps_suppkey", 10_000)
    result = s.estimate("(s_suppkey = ps_suppkey)", ["supplier", "partsupp"])
    s.apply("(s_suppkey = ps_suppkey)", ["supplier", "partsupp"])
    s.write(str(tmp_path / "stats"))
    again = Statistics.read(str(tmp_path / "stats"))
    assert again.relations == s.relations
    assert abs(again.estimate("(s_suppkey > 1000)", ["supplier", "partsupp"]) * 3 - result) < 0.1
    with pytest.raises(FileNotFoundError):
        Statistics.read(str(tmp_path / "none"))
    assert s.estimate(None, ["supplier"]) == 800_000
    assert s.selectivity("(1 = 1)") == 1 and s.selectivity("(1 = 2)") == 0
    assert s.selectivity("(s_suppkey = 1 OR ps_suppkey > 2)") > s.selectivity("(s_suppkey = 1)")
    s.copy_rel("supplier", "x")
    assert s.relations["x"].distinct["x.s_suppkey"] == 10_000
    s.collect("t", spark.range(50).selectExpr("id % 5 as a"), exact=True)
    assert s.relations["t"].rows == 50 and s.relations["t"].distinct == {"a": 5}


def test_streaming_operators(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:10"), (5, "2024-01-01 00:00:20"), (7, "2024-01-01 00:02:00")], "v int, at string").selectExpr(
        "v", "cast(at as timestamp) as at", "'k' as k"
    ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v int, at timestamp, k string").parquet(str(tmp_path / "in"))
    summed = windowed_sum(op.select_pipe(stream, "(v > 1)"), "at", "1 minute", "1 minute", ["k"], "v * 2")
    query = summed.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["sum"] for r in spark.table("sums").collect()) == [10, 14]


def test_positions_with_one_hot_key(spark):
    frame = spark.range(4000).selectExpr("id", "if(id % 3 > 0, 5, id % 50) as k")
    placed = op.positions(frame, ["k"], buckets=8)
    found = [(r.k, r.pos) for r in placed.collect()]
    assert sorted(p for _, p in found) == list(range(1, 4001))
    assert [k for k, _ in sorted(found, key=lambda x: x[1])] == sorted(k for k, _ in found)


def test_a_lookup_by_prefix_reads_few_rows(spark):
    tables = Tables(spark)
    spark.sql("DROP TABLE IF EXISTS prefix_t")
    tables.create("prefix_t", [("k", INTEGER), ("v", STRING)], "sorted", ("k",))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.add("prefix_t", spark.range(20_000).selectExpr("cast(id % 1000 as int) as k", "cast(id as string) as v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = tables.lookup("prefix_t", k=7)
    assert found.count() == 20
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = [leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())]
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,7)]" in plan.toString() and sum(read) <= 10_000
    tables.drop("prefix_t")


def test_sorted_runs_are_merged(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/home")
    spark.sql("DROP TABLE IF EXISTS runs_t")
    tables.create("runs_t", ATTRIBUTES, "sorted", ("a",))
    places = set()
    for k in range(20):
        tables.add("runs_t", compose(spark, [f"{20 - k}|1.5|x"], ATTRIBUTES))
        places.add(tables.properties("runs_t")["engine.location"])
        assert [r.a for r in tables.scan("runs_t").collect()] == list(range(20 - k, 21))
    assert len(places) == 3 and len(list((tmp_path / "home" / "quillon" / "runs_t").iterdir())) == 1
    spark.sql("DROP TABLE runs_t")
    again = Tables(spark, f"file://{tmp_path}/home")
    assert again.reopen("runs_t") and again.sort_keys("runs_t") == ("a",) and again.scan("runs_t").count() == 20
    again.drop("runs_t")
    assert not again.reopen("runs_t") and not (tmp_path / "home" / "quillon" / "runs_t").exists()


def test_command_line_keeps_tables(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in.txt").write_text("1|first\n2|second\n")
    (tmp_path / "raw.tbl").write_text("7|seven|\n")
    spark.sql("DROP TABLE IF EXISTS kept_t")

    def run(*lines):
        monkeypatch.setattr(sys, "stdin", io.StringIO("\n".join(lines)))
        session.main(["--home", str(tmp_path / "home"), "--data", str(tmp_path)])
        return capsys.readouterr().out

    run("CREATE TABLE kept_t (a INTEGER, c STRING) AS SORTED ON a", "INSERT 'in.txt' INTO kept_t", "EXIT")
    assert Statistics.read(str(tmp_path / "home" / "statistics")).relations["kept_t"].rows == 2
    spark.sql("DROP TABLE kept_t")
    catalog = tmp_path / "home" / "catalog"
    catalog.write_text(catalog.read_text() + "\nBEGIN\nraw_t\nraw.tbl\na Int\nc String\nEND\n")
    for crc in (tmp_path / "home").glob(".catalog*.crc"):
        crc.unlink()
    shown = run("SELECT k.c, r.c FROM kept_t AS k, raw_t AS r WHERE (k.a < r.a)", "SET OUTPUT NONE", "SELECT k.c FROM kept_t AS k WHERE (k.a = 2)", "DROP TABLE kept_t")
    assert "k_c: [first], r_c: [seven]" in shown and "Total records: 2" in shown
    assert "#1 Select_File kept_t AS k\n    attributes: k.a int, k.c string\n    where: (k.a = 2)\n#2 Project #1" in shown
    assert "kept_t" not in read_catalog(str(catalog)) and not Statistics.read(str(tmp_path / "home" / "statistics")).has("kept_t")
