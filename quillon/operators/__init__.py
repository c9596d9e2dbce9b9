"""Relational operators over DataFrames; all but ``numbered`` and what uses it are lazy."""

from .relational import (
    duplicate_removal,
    group_by,
    join,
    numbered,
    order_violations,
    ordered_union,
    positions,
    project,
    select_file,
    select_pipe,
    sort,
    sort_all,
    sum_,
    write_lines,
    write_out,
)

__all__ = [
    "duplicate_removal",
    "group_by",
    "join",
    "numbered",
    "order_violations",
    "ordered_union",
    "positions",
    "project",
    "select_file",
    "select_pipe",
    "sort",
    "sort_all",
    "sum_",
    "write_out",
    "write_lines",
]
