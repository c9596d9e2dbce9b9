"""Text tables: one row per line, fields separated (and optionally ended) by ``|``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import STRING, spark_type

BAD_NUMBER = ("zero", "null", "fail")


def read_text(spark: SparkSession, path: str, attributes: list[tuple[str, str]], on_bad_number: str = "zero") -> DataFrame:
    """The rows of a text file. A field that is no number counts as 0, as null,
    or fails the query, as ``on_bad_number`` says; a missing field is a bad
    number or an empty string. Blank lines are no rows."""
    lines = spark.read.text(path)
    return _fields(lines, attributes, on_bad_number)


def compose(spark: SparkSession, lines: list[str], attributes: list[tuple[str, str]], on_bad_number: str = "zero") -> DataFrame:
    """Rows from strings in memory."""
    return _fields(spark.createDataFrame([(x,) for x in lines], "value string"), attributes, on_bad_number)


def _fields(lines: DataFrame, attributes: list[tuple[str, str]], on_bad_number: str) -> DataFrame:
    if on_bad_number not in BAD_NUMBER:
        raise ValueError(f"on_bad_number is one of {', '.join(BAD_NUMBER)}")
    parts = F.split("value", r"\|")
    columns = []
    for k, (name, kind) in enumerate(attributes):
        field = F.coalesce(F.get(parts, k), F.lit(""))
        if kind == STRING:
            columns.append(field.alias(name))
            continue
        kind_of_spark: T.DataType = spark_type(kind)
        number = F.trim(field).try_cast(kind_of_spark)
        if on_bad_number == "zero":
            number = F.coalesce(number, F.lit(0).cast(kind_of_spark))
        elif on_bad_number == "fail":
            number = F.coalesce(number, F.raise_error(F.concat(F.lit(f"{name}: not a number: "), field)).cast(kind_of_spark))
        columns.append(number.alias(name))
    return lines.filter(F.length(F.trim("value")) > 0).select(columns)
