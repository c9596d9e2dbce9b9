"""Conditions in conjunctive normal form as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ast
from ..plans.binder import BindError, Scope
from ..types import DOUBLE, INTEGER, STRING, kind_of


def _operand(operand: ast.Name | ast.Literal, scope: Scope) -> tuple[Column, str | None]:
    if isinstance(operand, ast.Name):
        return scope.column(operand.text), kind_of(scope.type_of(operand.text))
    value = operand.value
    return F.lit(value), STRING if isinstance(value, str) else INTEGER if isinstance(value, int) else DOUBLE


def comparison(term: ast.Comparison, scope: Scope, strict_types: bool = False) -> Column:
    """Strings compare by bytes. Numbers widen; with ``strict_types`` both
    sides must be of one type. Dates compare with strings that name dates."""
    (left, kind_left), (right, kind_right) = _operand(term.left, scope), _operand(term.right, scope)
    known = kind_left is not None and kind_right is not None
    if known and (kind_left != kind_right if strict_types else (kind_left == STRING) != (kind_right == STRING)):
        raise BindError(f"{term}: {kind_left} does not compare with {kind_right}")
    return {"<": left < right, ">": left > right, "=": left == right}[term.op]


def predicate(cnf: ast.Cnf, scope: Scope, strict_types: bool = False) -> Column:
    """OR groups stay whole, so each is pushed to the lowest place that has all its columns."""
    groups = [reduce(lambda a, b: a | b, [comparison(t, scope, strict_types) for t in group]) for group in cnf.groups]
    return reduce(lambda a, b: a & b, groups)
