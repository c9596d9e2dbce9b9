"""Names to columns.

Each table of a FROM clause is a DataFrame whose columns are called
``alias.attribute``. A name is looked up among all of them, once; unknown and
ambiguous names are errors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


class BindError(ValueError):
    """A name that cannot be resolved, or types that do not go together."""


class Scope:
    """The columns that names may mean. Bare frames (without aliases) have plain names."""

    def __init__(self, frames: Iterable[DataFrame]) -> None:
        self.types: dict[str, DataType] = {}
        for frame in frames:
            for field in frame.schema.fields:
                if field.name in self.types:
                    raise BindError(f"{field.name} occurs twice")
                self.types[field.name] = field.dataType

    def resolve(self, name: str) -> str:
        """The full column name."""
        if name in self.types:
            return name
        found = [c for c in self.types if c.rpartition(".")[2] == name]
        if len(found) != 1:
            raise BindError(f"{name} is {'ambiguous: ' + ', '.join(found) if found else 'unknown'}")
        return found[0]

    def column(self, name: str) -> Column:
        return F.col(f"`{self.resolve(name)}`")

    def type_of(self, name: str) -> DataType:
        return self.types[self.resolve(name)]

    def output_names(self, columns: list[str]) -> list[str]:
        """The attribute where that is unique among ``columns``, else alias_attribute."""
        short = [c.rpartition(".")[2] for c in columns]
        return [s if short.count(s) == 1 else c.replace(".", "_") for s, c in zip(short, columns, strict=True)]


def aliased(frame: DataFrame, alias: str) -> DataFrame:
    return frame.select([F.col(f"`{c}`").alias(f"{alias}.{c}") for c in frame.columns])
