"""URL filtering with a trie over reversed host labels and path segments.

Rules are (verdict, host, path prefix). A rule fits its host and all
subdomains where the URL's path starts with the rule's path; the longest rule
wins: more host labels first, then the longer path. The trie is a dict that
goes to the executors with the function; it has ``MAX_RULES`` rules at most,
and more rules take several passes over the rows, without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and
path and gets the default verdict; repeated rows come out repeated; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the query (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rules of one pass, as the trie is sent to every task.
MAX_RULES = 1_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: The same with the rank of the rule: host labels, letters of the path, and its place from behind.
RANKED = SCHEMA + ", labels int, letters int, place int"


def build_trie(rules: Iterable[tuple[str, str, str]], first: int = 0) -> dict:
    """Nested dicts. A host node has "labels" (reversed labels) and, where a
    rule ends, "path": a trie of whole path segments, in which rules end inside
    the next segment: "starts" has these by the beginning, "sizes" the lengths
    of beginnings, longest first. Of equal rules the first counts; ``first`` is its number."""
    root: dict = {"labels": {}}
    for n, (verdict, host, path) in enumerate(rules, first):
        node, labels = root, host.lower().split(".")
        for label in reversed(labels):
            node = node["labels"].setdefault(label, {"labels": {}})
        node = node.setdefault("path", {"next": {}, "starts": {}, "sizes": []})
        *whole, part = path.split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "starts": {}, "sizes": []})
        if len(part) not in node["sizes"]:
            node["sizes"] = sorted([*node["sizes"], len(part)], reverse=True)
        node["starts"].setdefault(part, (host + path, verdict, len(labels), len(path), -n))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple | None:
    """(rule, verdict, labels, letters, place) of the deepest host node, and there the longest path, that fits."""
    found, node = None, trie
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        best = _longest_path(node["path"], path) if "path" in node else None
        found = best or found
    return found


def _longest_path(node: dict, path: str) -> tuple | None:
    found = None
    for segment in path.split("/"):
        for size in node["sizes"]:
            if (own := node["starts"].get(segment[:size])) is not None:
                found = own
                break
        node = node["next"].get(segment)
        if node is None:
            break
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path, as the URL has them; both may be empty."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url)."""
    rules, names = list(rules), [x.split()[0] for x in RANKED.split(", ")]
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 3]

    def rows(ids: pa.Array, parts: list[tuple[str, str]], found: list[tuple | None]) -> pa.RecordBatch:
        nothing = (None, default, None, None, None)
        own = [pa.array([(f or nothing)[k] for f in found], t) for k, t in enumerate(kinds)]
        host, path = (pa.array([p[k] for p in parts], pa.string()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), host, path, *own], names)

    first = build_trie(rules[:MAX_RULES])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            yield rows(batch.column(0), parts, [longest_match(first, h, p) if h else None for h, p in parts])

    out = pages.select(F.col("page_id").cast("long"), "url").mapInArrow(judge, RANKED)
    for at in range(MAX_RULES, len(rules), MAX_RULES):
        trie = build_trie(rules[at : at + MAX_RULES], at)

        def better(batches: Iterator[pa.RecordBatch], trie: dict = trie) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(1, len(names))]
                parts = list(zip(*columns[:2], strict=True))
                known = [row if row[0] is not None else None for row in zip(*columns[2:], strict=True)]
                new = [longest_match(trie, h, p) if h else None for h, p in parts]
                both = [max((x for x in two if x), key=lambda x: x[2:], default=None) for two in zip(known, new, strict=True)]
                yield rows(batch.column(0), parts, both)

        out = out.mapInArrow(better, RANKED)
    return out.select(*[x.split()[0] for x in SCHEMA.split(", ")])
