"""The operators that the planner composes, usable by themselves.

Conditions and functions are given as text of the dialect or as parsed trees.
Nothing is executed here but for ``numbered``, which writes its rows: Catalyst
pushes predicates and columns into the scan, picks join strategies and
aggregates partially before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import arithmetic
from ..functions.predicates import predicate
from ..plans import ast
from ..plans.binder import Scope
from ..plans.parser import parse_cnf, parse_expression, parse_sort_keys
from ..sources.files import shared_dir
from ..types import DOUBLE, INTEGER, STRING, kind_of


def _cnf(condition: str | ast.Cnf) -> ast.Cnf:
    return parse_cnf(condition) if isinstance(condition, str) else condition


def _tree(function: str | ast.Expression) -> ast.Expression:
    return parse_expression(function) if isinstance(function, str) else function


def select_file(spark: SparkSession, table: str, condition: str | ast.Cnf, strict_types: bool = False) -> DataFrame:
    """Scan a table of the session's catalog and filter it."""
    return select_pipe(spark.table(table), condition, strict_types)


def select_pipe(rows: DataFrame, condition: str | ast.Cnf, strict_types: bool = False) -> DataFrame:
    """Filter; also of a streaming DataFrame."""
    return rows.filter(predicate(_cnf(condition), Scope([rows]), strict_types))


def project(rows: DataFrame, keep: Sequence[int | str]) -> DataFrame:
    """Keep and reorder columns, by place or name."""
    names = [rows.columns[k] if isinstance(k, int) else Scope([rows]).resolve(k) for k in keep]
    return rows.select([F.col(f"`{n}`") for n in names])


def join(left: DataFrame, right: DataFrame, condition: str | ast.Cnf | None = None, strict_types: bool = False) -> DataFrame:
    """Inner join over the full condition: columns of left, then of right. With
    an equality between both sides Spark sorts, hashes or broadcasts; without,
    it loops; without any condition this is the cross product."""
    if condition is None:
        return left.crossJoin(right)
    return left.join(right, predicate(_cnf(condition), Scope([left, right]), strict_types))


def duplicate_removal(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def _total(rows: DataFrame, function: str | ast.Expression, distinct: bool) -> Column:
    column, _ = arithmetic(_tree(function), Scope([rows]))
    return F.sum_distinct(column) if distinct else F.sum(column)


def sum_(rows: DataFrame, function: str | ast.Expression, distinct: bool = False) -> DataFrame:
    """One row ``sum``; no row for empty input. ``distinct``: of distinct values."""
    totals = rows.agg(_total(rows, function, distinct).alias("sum"), F.count(F.lit(1)).alias("n"))
    return totals.filter("n > 0").select("sum")


def group_by(rows: DataFrame, keys: Sequence[str], function: str | ast.Expression, distinct: bool = False) -> DataFrame:
    """``sum`` and then the keys, a row for each group."""
    scope = Scope([rows])
    own = [scope.resolve(k) for k in keys]
    return rows.groupBy(*[F.col(f"`{k}`") for k in own]).agg(_total(rows, function, distinct).alias("sum")).select("sum", *[f"`{k}`" for k in own])


def sort(rows: DataFrame, keys: str | Sequence[str], run_length: int = 1) -> DataFrame:
    """Global ascending sort; Spark's sorter spills. ``keys``: names, or a
    condition that states them. ``run_length`` is checked but has no effect."""
    if run_length < 1:
        raise ValueError("the run length is 1 at least")
    scope = Scope([rows])
    names = parse_sort_keys(keys) if isinstance(keys, str) else keys
    return rows.orderBy(*[scope.column(k).asc() for k in names])


def _keys(rows: DataFrame, keys: str | Sequence[str]) -> list[Column]:
    scope = Scope([rows])
    return [scope.column(k) for k in (parse_sort_keys(keys) if isinstance(keys, str) else keys)]


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``: their place, from 1, in the order that they are in.
    They are written to the shared folder with their place in their partition;
    the partitions' sizes, a row each, then give the rest."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(rows.sparkSession))
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # A row for each partition: their number bounds what is broadcast.
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("pos", (F.col("_before") + place + 1).cast("long")).drop("_part", "_at", "_before")


def positions(rows: DataFrame, keys: str | Sequence[str], buckets: int | None = None) -> DataFrame:
    """The rows with ``pos``: their place, from 1, in the order of ``keys``.
    Rows are dealt by ranges of all keys and, where these are equal, of a number
    of their own, so no value is too frequent for a task."""
    own = _keys(rows, keys)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = [*own, F.col("_tie")]
    dealt = tied.repartitionByRange(buckets, *ranges) if buckets else tied.repartitionByRange(*ranges)
    return numbered(dealt.sortWithinPartitions(*ranges).drop("_tie"))


def order_violations(rows: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row: ``n``, the number of neighbours, in the order that the rows are in, that are out of order by ``keys``."""
    placed = numbered(rows)
    columns = [f"_k{k}" for k in range(len(_keys(rows, keys)))]
    own = placed.select("pos", *[c.alias(n) for c, n in zip(_keys(placed, keys), columns, strict=True)])
    after = own.select((F.col("pos") - 1).alias("pos"), *[F.col(c).alias(f"{c}_next") for c in columns])
    wrong = F.struct(*columns) > F.struct(*[F.col(f"{c}_next").alias(c) for c in columns])
    return own.join(after, "pos").filter(wrong).agg(F.count(F.lit(1)).alias("n"))


def sort_all(rows: DataFrame) -> DataFrame:
    """Sort on all attributes: integers first, then doubles, then strings, in schema order within each."""
    kinds = {f.name: kind_of(f.dataType) for f in rows.schema.fields}
    return sort(rows, [n for kind in (INTEGER, DOUBLE, STRING) for n, k in kinds.items() if k == kind])


def ordered_union(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of both, repeated ones too, in key order."""
    return sort(old.unionByName(new), keys)


def write_lines(rows: DataFrame) -> DataFrame:
    """A column ``line``: ``name:[value], name:[value]``, doubles with six decimals."""
    parts = []
    for field in rows.schema.fields:
        value = F.col(f"`{field.name}`")
        text = F.format_string("%f", value) if kind_of(field.dataType) == DOUBLE else value.cast("string")
        parts.append(F.concat(F.lit(f"{field.name}:["), text, F.lit("]")))
    return rows.select(F.concat_ws(", ", *parts).alias("line"))


def write_out(rows: DataFrame, path: str) -> None:
    """Write the rows as text, a part file for each partition."""
    write_lines(rows).write.mode("overwrite").text(path)
