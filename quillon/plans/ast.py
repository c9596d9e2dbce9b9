"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Literal:
    value: int | float | str

    def __str__(self) -> str:
        return "'" + self.value.replace("'", "\\'") + "'" if isinstance(self.value, str) else repr(self.value)


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Negate:
    operand: Expression

    def __str__(self) -> str:
        return f"(- {self.operand})"


Expression = Name | Literal | Binary | Negate


@dataclass(frozen=True)
class Comparison:
    left: Name | Literal
    op: str
    right: Name | Literal

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Cnf:
    """AND of ORs of comparisons."""

    groups: tuple[tuple[Comparison, ...], ...]

    def __str__(self) -> str:
        return " AND ".join("(" + " OR ".join(map(str, g)) + ")" for g in self.groups)


@dataclass(frozen=True)
class Sum:
    argument: Expression
    distinct: bool


@dataclass(frozen=True)
class Select:
    sum: Sum | None
    attributes: tuple[Name, ...]
    distinct: bool
    tables: tuple[tuple[str, str], ...]
    where: Cnf
    group_by: tuple[Name, ...]


@dataclass(frozen=True)
class Create:
    table: str
    attributes: tuple[tuple[str, str], ...]
    kind: str
    sort_keys: tuple[str, ...]


@dataclass(frozen=True)
class Insert:
    file: str
    table: str


@dataclass(frozen=True)
class Drop:
    table: str


@dataclass(frozen=True)
class SetOutput:
    target: str
    is_file: bool


@dataclass(frozen=True)
class Exit:
    pass


Statement = Select | Create | Insert | Drop | SetOutput | Exit
