"""Arithmetic trees as columns.

Integer with integer stays integer (64 bits, so sums do not wrap), anything
else is double; strings are refused. Integer division truncates. Division by
zero is an error of the query, in either type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ast
from ..plans.binder import BindError, Scope
from ..types import DOUBLE, INTEGER, kind_of


def arithmetic(tree: ast.Expression, scope: Scope) -> tuple[Column, str]:
    """The column and its type, INTEGER or DOUBLE."""
    match tree:
        case ast.Literal(value):
            kind = INTEGER if isinstance(value, int) else DOUBLE
            return F.lit(value).cast("long" if kind == INTEGER else "double"), kind
        case ast.Name(text):
            kind = kind_of(scope.type_of(text))
            if kind not in (INTEGER, DOUBLE):
                raise BindError(f"{text} is not a number")
            return scope.column(text).cast("long" if kind == INTEGER else "double"), kind
        case ast.Negate(operand):
            column, kind = arithmetic(operand, scope)
            return -column, kind
        case ast.Binary(op, left, right):
            (a, kind_a), (b, kind_b) = arithmetic(left, scope), arithmetic(right, scope)
            kind = INTEGER if kind_a == kind_b == INTEGER else DOUBLE
            if kind == DOUBLE:
                a, b = a.cast("double"), b.cast("double")
            if op == "/":
                return (F.call_function("div", a, b) if kind == INTEGER else a / b), kind
            return {"+": a + b, "-": a - b, "*": a * b}[op], kind
    raise BindError(f"not an expression: {tree!r}")
