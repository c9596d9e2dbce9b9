"""The three types of the relational model and what they are in Spark."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGER, DOUBLE, STRING = "INTEGER", "DOUBLE", "STRING"

_SPARK = {INTEGER: T.IntegerType(), DOUBLE: T.DoubleType(), STRING: T.StringType()}
#: Type names of the statement language and of catalog files.
_NAMES = {"INTEGER": INTEGER, "DOUBLE": DOUBLE, "STRING": STRING, "Int": INTEGER, "Double": DOUBLE, "String": STRING}
CATALOG_NAMES = {INTEGER: "Int", DOUBLE: "Double", STRING: "String"}


def parse_type(name: str) -> str:
    """One of INTEGER, DOUBLE, STRING; an unknown name is an error."""
    if name not in _NAMES:
        raise ValueError(f"unknown type {name!r}")
    return _NAMES[name]


def spark_type(kind: str) -> T.DataType:
    return _SPARK[kind]


def kind_of(data_type: T.DataType) -> str | None:
    """The model's type of a Spark type; None for those it has none for (dates, nested types)."""
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, T.FractionalType):
        return DOUBLE
    if isinstance(data_type, T.StringType):
        return STRING
    return None


def struct(attributes: list[tuple[str, str]]) -> T.StructType:
    """A Spark schema from (name, type) pairs, without nulls."""
    return T.StructType([T.StructField(name, spark_type(kind), False) for name, kind in attributes])
