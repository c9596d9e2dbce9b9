"""Catalog files: blocks of ``BEGIN``, table, file, ``attribute Type`` lines, ``END``."""

from __future__ import annotations

from dataclasses import dataclass

from . import files
from ..types import CATALOG_NAMES, parse_type


@dataclass(frozen=True)
class Entry:
    table: str
    file: str
    attributes: tuple[tuple[str, str], ...]


def parse_catalog(text: str) -> dict[str, Entry]:
    """Entries by table; an unknown type or an open block is an error."""
    out: dict[str, Entry] = {}
    words = iter(text.split())
    for word in words:
        if word != "BEGIN":
            raise ValueError(f"BEGIN expected, {word} found")
        try:
            table, file, attributes = next(words), next(words), []
            while (name := next(words)) != "END":
                attributes.append((name, parse_type(next(words))))
        except StopIteration:
            raise ValueError("the last block has no END") from None
        out[table] = Entry(table, file, tuple(attributes))
    return out


def read_catalog(path: str) -> dict[str, Entry]:
    return parse_catalog(files.read(path))


def format_catalog(entries: dict[str, Entry]) -> str:
    blocks = []
    for e in entries.values():
        lines = ["BEGIN", e.table, e.file, *[f"{n} {CATALOG_NAMES[k]}" for n, k in e.attributes], "END"]
        blocks.append("\n".join(lines) + "\n")
    return "\n".join(blocks)


def write_catalog(entries: dict[str, Entry], path: str) -> None:
    files.write(path, format_catalog(entries))
