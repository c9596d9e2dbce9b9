"""Statements in, DataFrames or effects out; and a command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import write_out
from .plans import ast
from .plans.parser import ParseError, parse_statement
from .plans.planner import explain, plan_select
from .plans.statistics import Statistics
from .sources import files
from .sources.catalog import Entry, read_catalog, write_catalog
from .sources.tables import Tables
from .sources.text import BAD_NUMBER, read_text
from .types import parse_type


@dataclass
class Result:
    """What a statement gave: rows (SELECT, lazy), text to show, and whether the session goes on."""

    rows: DataFrame | None = None
    text: str = ""
    goes_on: bool = True


class Engine:
    """A session of the dialect. ``views``: further tables by name, as
    DataFrames. ``home``: a folder that holds the tables, the catalog file and
    the statistics file, so that they outlive the session; CREATE, INSERT and
    DROP keep them up to date, SELECT reads them."""

    def __init__(
        self,
        spark: SparkSession,
        views: Callable[[str], DataFrame | None] | dict[str, DataFrame] | None = None,
        data_dir: str = ".",
        statistics: Statistics | None = None,
        strict_types: bool = False,
        on_bad_number: str = "zero",
        home: str | None = None,
    ) -> None:
        self.home = files.qualified(home) if home else None
        self.spark, self.tables, self.data_dir = spark, Tables(spark, self.home), data_dir.rstrip("/")
        self.views = views.get if isinstance(views, dict) else views or (lambda name: None)
        self.statistics, self.strict_types, self.on_bad_number = statistics, strict_types, on_bad_number
        self.output, self.output_is_file = "STDOUT", False
        if self.home and statistics is None:
            path = f"{self.home}/statistics"
            self.statistics = Statistics.read(path) if files.exists(path) else Statistics()

    def catalog(self) -> dict[str, Entry]:
        """The entries of the catalog file; none without a home folder."""
        path = f"{self.home}/catalog"
        return read_catalog(path) if self.home and files.exists(path) else {}

    def _keep(self, entries: dict[str, Entry] | None = None) -> None:
        if self.home:
            if entries is not None:
                write_catalog(entries, f"{self.home}/catalog")
            self.statistics.write(f"{self.home}/statistics")

    def collect_statistics(self, name: str, exact: bool = False) -> None:
        """Count rows and distinct values of a table."""
        self.statistics = self.statistics or Statistics()
        self.statistics.collect(name, self.table(name), exact=exact)
        self._keep()

    def table(self, name: str) -> DataFrame:
        found = self.views(name)
        if found is not None:
            return found
        if self.tables.reopen(name):
            return self.spark.table(name)
        # A table of the catalog file may be a text file that was never loaded.
        if (entry := self.catalog().get(name)) is None:
            raise ValueError(f"no table {name}")
        path = entry.file if "/" in entry.file else f"{self.data_dir}/{entry.file}"
        return read_text(self.spark, path, list(entry.attributes), self.on_bad_number)

    def query(self, text: str) -> DataFrame:
        """The rows of a SELECT, whatever the output is set to."""
        statement = parse_statement(text)
        if not isinstance(statement, ast.Select):
            raise ParseError("a SELECT expected")
        return plan_select(statement, self.table, self.statistics, self.strict_types)

    def explain(self, text: str) -> str:
        statement = parse_statement(text)
        return explain(statement, plan_select(statement, self.table, self.statistics, self.strict_types), self.table)

    def execute(self, text: str) -> Result:
        match statement := parse_statement(text):
            case ast.Select():
                rows = plan_select(statement, self.table, self.statistics, self.strict_types)
                return self._put_out(statement, rows)
            case ast.Create(table, attributes, kind, keys):
                own = [(n, parse_type(t)) for n, t in attributes]
                self.tables.create(table, own, kind, keys)
                if self.statistics is not None:
                    self.statistics.add_rel(table, 0)
                    for name, _ in attributes:
                        self.statistics.add_att(table, name, 0)
                self._keep(self.catalog() | {table: Entry(table, f"{table}.table", tuple(own))})
                return Result(text=f"Created {table}")
            case ast.Insert(file, table):
                path = file if "/" in file else f"{self.data_dir}/{file}"
                if not self.tables.reopen(table):
                    raise ValueError(f"no table {table}")
                self.tables.add(table, read_text(self.spark, path, self.tables.attributes(table), self.on_bad_number))
                if self.home:
                    self.collect_statistics(table)
                return Result(text=f"Loaded {table}")
            case ast.Drop(table):
                self.tables.reopen(table)
                self.tables.drop(table)
                if self.statistics is not None:
                    self.statistics.drop_rel(table)
                self._keep({n: e for n, e in self.catalog().items() if n != table})
                return Result(text=f"Dropped {table}")
            case ast.SetOutput(target, is_file):
                if not is_file and target not in ("NONE", "STDOUT"):
                    raise ParseError("the output is NONE, STDOUT or a file name")
                self.output, self.output_is_file = target, is_file
                return Result(text=f"Output {target}")
            case ast.Exit():
                return Result(goes_on=False)
        raise ParseError("not a statement")

    def _put_out(self, statement: ast.Select, rows: DataFrame) -> Result:
        if self.output_is_file:
            write_out(rows, self.output)
            return Result(rows, f"Total records: {self.spark.read.text(self.output).count()}")
        if self.output == "NONE":
            return Result(rows, explain(statement, rows, self.table))
        return Result(rows)


def display(rows: DataFrame) -> str:
    """All rows as text with their number. They pass by one partition at a time."""
    out = ["Query Result :"]
    for row in rows.toLocalIterator():
        values = (f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
        out.append(", ".join(f"{n}: [{v}]" for n, v in zip(rows.columns, values, strict=True)))
    return "\n".join([*out, f"Total records: {len(out) - 1}"])


def options(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quillon", description="Reads one statement per line.")
    parser.add_argument("--home", default="quillon-home", help="folder of tables, catalog and statistics")
    parser.add_argument("--data", default=".", help="folder of files that INSERT names")
    parser.add_argument("--parquet", help="folder of Parquet tables that SELECT may name")
    parser.add_argument("--strict-types", action="store_true")
    parser.add_argument("--on-bad-number", choices=BAD_NUMBER, default="zero")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    """Read one statement per line until EXIT or the end."""
    given = options(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("quillon").getOrCreate()

    def view(name: str) -> DataFrame | None:
        path = f"{given.parquet}/{name}.parquet"
        return spark.read.parquet(path) if given.parquet and files.exists(path) else None

    engine = Engine(spark, view, given.data, None, given.strict_types, given.on_bad_number, given.home)
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            result = engine.execute(line)
        except Exception as error:  # noqa: BLE001  the session goes on after a bad statement
            print(f"error: {error}")
            continue
        if not result.goes_on:
            break
        print(result.text or (display(result.rows) if result.rows is not None else ""))


if __name__ == "__main__":
    main()
