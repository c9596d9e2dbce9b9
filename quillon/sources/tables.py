"""Heap and sorted tables over Spark's catalog and Parquet.

A heap is appended to. A sorted table keeps its keys as a table property; each
load is a run of its own, range-partitioned and sorted by the keys, so equality
on a key prefix reads only the row groups whose minimum and maximum allow it.
After ``MAX_RUNS`` runs all are merged into one: it is written to a new folder,
to which the table then points, so there is a whole table at any time.

With a ``home`` folder, tables outlive the session: beside its data each table
has a file of its properties, from which ``reopen`` makes it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import struct
from . import files

KIND, KEYS, ATTRIBUTES, RUNS, LOCATION = "engine.kind", "engine.sort_keys", "engine.attributes", "engine.runs", "engine.location"
KINDS = ("heap", "sorted")
#: Sorted runs of a table before they are merged.
MAX_RUNS = 8


class Tables:
    """The session's tables."""

    def __init__(self, spark: SparkSession, home: str | None = None) -> None:
        self.spark, self.home = spark, home.rstrip("/") if home else None

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def _new_folder(self, table: str) -> str:
        root = self.home or self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        return f"{root}/quillon/{table}/{uuid.uuid4().hex}"

    def create(self, table: str, attributes: list[tuple[str, str]], kind: str = "heap", sort_keys: tuple[str, ...] = ()) -> None:
        if kind not in KINDS:
            raise ValueError(f"a table is {' or '.join(KINDS)}, not {kind!r}")
        if self.exists(table):
            raise ValueError(f"table {table} exists")
        names = [n for n, _ in attributes]
        if len(set(names)) < len(names):
            raise ValueError("an attribute occurs twice")
        if (kind == "sorted") != bool(sort_keys) or not set(sort_keys) <= set(names):
            raise ValueError("a sorted table has keys, which are among its attributes; a heap has none")
        location = self._new_folder(table)
        self.spark.createDataFrame([], struct(attributes)).write.parquet(location)
        listed = ",".join(f"{n} {t}" for n, t in attributes)
        self._register(table, {KIND: kind, KEYS: ",".join(sort_keys), ATTRIBUTES: listed, RUNS: "0", LOCATION: location})

    def _register(self, table: str, values: dict[str, str]) -> None:
        """One statement makes the table with all its properties."""
        attributes = [tuple(x.split()) for x in values[ATTRIBUTES].split(",") if x]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct(attributes).fields)
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in values.items())
        self.spark.sql(f"CREATE TABLE `{table}` ({columns}) USING parquet TBLPROPERTIES ({listed}) LOCATION '{values[LOCATION]}'")
        self._keep(table, values)

    def _keep(self, table: str, values: dict[str, str]) -> None:
        if self.home:
            files.write(f"{self.home}/{table}.table", "".join(f"{k}={v}\n" for k, v in values.items()))

    def _change(self, table: str, changed: dict[str, str]) -> None:
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in changed.items())
        self.spark.sql(f"ALTER TABLE `{table}` SET TBLPROPERTIES ({listed})")
        self._keep(table, {k: v for k, v in self.properties(table).items() if k.startswith("engine.")})

    def reopen(self, table: str) -> bool:
        """Whether the table is there, if need be from its file in the home folder."""
        if not self.exists(table) and self.home and files.exists(f"{self.home}/{table}.table"):
            lines = files.read(f"{self.home}/{table}.table").splitlines()
            self._register(table, dict(line.split("=", 1) for line in lines))
        return self.exists(table)

    def properties(self, table: str) -> dict[str, str]:
        return {r[0]: r[1] for r in self.spark.sql(f"SHOW TBLPROPERTIES `{table}`").collect()}

    def kind(self, table: str) -> str:
        return self.properties(table).get(KIND, "heap")

    def sort_keys(self, table: str) -> tuple[str, ...]:
        return tuple(k for k in self.properties(table).get(KEYS, "").split(",") if k)

    def attributes(self, table: str) -> list[tuple[str, str]]:
        listed = self.properties(table).get(ATTRIBUTES, "")
        return [tuple(x.split()) for x in listed.split(",") if x]  # type: ignore[misc]

    def add(self, table: str, rows: DataFrame) -> None:
        """Append to a heap; add a sorted run to a sorted table."""
        known = self.properties(table)
        keys, columns = self.sort_keys(table), [n for n, _ in self.attributes(table)] or self.spark.table(table).columns
        rows = rows.select([F.col(f"`{c}`") for c in columns])
        if not keys:
            rows.write.insertInto(table)
            return
        if (runs := int(known.get(RUNS, "0")) + 1) < MAX_RUNS:
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.insertInto(table)
            self._change(table, {RUNS: str(runs)})
            return
        location, old = self._new_folder(table), known[LOCATION]
        merged = self.spark.table(table).unionByName(rows)
        merged.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(location)
        self.spark.sql(f"ALTER TABLE `{table}` SET LOCATION '{location}'")
        self._change(table, {RUNS: "1", LOCATION: location})
        self.spark.catalog.refreshTable(table)
        files.remove(old)

    def scan(self, table: str) -> DataFrame:
        """All rows; of a sorted table in key order."""
        keys = self.sort_keys(table)
        rows = self.spark.table(table)
        return rows.orderBy(*keys) if keys else rows

    def lookup(self, table: str, **values: object) -> DataFrame:
        """Rows with these values; Parquet's row-group statistics skip the rest of a sorted table."""
        rows = self.spark.table(table)
        for name, value in values.items():
            rows = rows.filter(F.col(f"`{name}`") == F.lit(value))
        return rows

    def drop(self, table: str) -> None:
        if not self.exists(table):
            raise ValueError(f"no table {table}")
        location = self.properties(table).get(LOCATION)
        self.spark.sql(f"DROP TABLE `{table}`")
        if self.home:
            files.remove(f"{self.home}/{table}.table")
        if location:
            files.remove(location.rpartition("/")[0])
