"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, compared without regard to the case of
Latin-1 letters; ASCII punctuation only ends them. Runs of ``seed_words``
words that a document shares with a test item are the seeds; only the words
around them go on. There the longest match whose words are all unmarked, found
by Karp-Rabin hashes of windows and compared word by word, is marked in both
texts, again and again, until none of ``seed_words`` words is left. A document
is tiled as a whole, whatever its length. The marked share of the item is its
coverage: passages in another order count in full. A document is
contaminated if an item reaches ``min_coverage``.

The items go to the executors. Their size is checked: beyond ``block_bytes``
they are handled in blocks of at most that size, one pass over the documents
for each, and the best of the passes counts. Documents are never shuffled
unless there is more than one block.

Defined results: null text counts as empty; items without words match nothing;
items of fewer than ``seed_words`` words match as a whole; of items with equal
coverage the smallest item_id is named; repeated rows come out repeated; an
empty table of documents or items gives no or only clean rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .wordhash import BASE, INVERSE, MARKS, WordHasher, powers, shingles

SEED_WORDS = 5
MIN_COVERAGE = 0.75
BLOCK_BYTES = 16_000_000
SCHEMA = "doc_id long, contaminated boolean, coverage double, item_id long, items array<long>"
_FILTER_BITS = 22


def _free(used: np.ndarray) -> np.ndarray:
    """How many words in a row are unmarked from each place on."""
    ends = np.flatnonzero(np.append(used, True))
    places = np.arange(len(used))
    return ends[np.searchsorted(ends, places)] - places


class _Windows:
    """A sequence, its marks, and Karp-Rabin hashes of its windows of any length."""

    def __init__(self, words: np.ndarray, used: np.ndarray) -> None:
        self.words, self.used = words, used
        power, self.inverse = powers(BASE, len(words) + 1), powers(INVERSE, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[:-1], out=self.sums[1:])

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked windows of ``size`` words."""
        at = np.flatnonzero(_free(self.used) >= size)
        return at, (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def mark(self, at: int, size: int) -> None:
        self.used[at : at + size] = True

    def open(self, at: int, size: int) -> bool:
        return not self.used[at : at + size].any()


def _mark_all(doc: _Windows, item: _Windows, size: int) -> int:
    """Mark the matches of ``size`` words, leftmost in the item and then in the
    document; those that overlap a marked one are none. Words are compared."""
    at, found = doc.of(size)
    order = np.argsort(found, kind="stable")
    at, found = at[order], found[order]
    places, wanted = item.of(size)
    first, last = np.searchsorted(found, wanted, "left"), np.searchsorted(found, wanted, "right")
    next_of: dict[int, int] = {}  # of equal windows of the document, those before are marked
    count = 0
    for j, a, b in zip(places[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
        if not item.open(j, size):
            continue
        x = next_of.get(a, a)
        while x < b and not doc.open(int(at[x]), size):
            x += 1
        next_of[a] = x
        if x < b and np.array_equal(doc.words[at[x] : at[x] + size], item.words[j : j + size]):
            item.mark(j, size)
            doc.mark(int(at[x]), size)
            count += 1
    return count


def tile(doc: np.ndarray, item: np.ndarray, k: int, marked: np.ndarray, used: np.ndarray | None = None) -> int:
    """Greedy tiling of two sequences of words (as numbers): matches of the
    greatest length are marked first, down to ``k`` words. ``marked`` has the
    item's marks and gets the new ones, ``used`` those of the document; returns
    the number of the item's words newly marked. The greatest length is found by
    bisection, as each match holds matches of all smaller lengths; so this takes
    the same time for repetitive texts as for others."""
    a, b = _Windows(doc, np.zeros(len(doc), bool) if used is None else used), _Windows(item, marked)
    before = int(marked.sum())
    most = min(len(doc), len(item))
    while most >= k:
        low, high = k - 1, most
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(b.of(size)[1], a.of(size)[1]).any():
                low = size
            else:
                high = size - 1
        if low < k:
            break
        _mark_all(a, b, low)
        most = low - 1
    return int(marked.sum()) - before


def _around(words: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that are in some run of ``k`` at ``places``, and a mark where some are left out between them."""
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + k, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1])
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    part, marks = np.insert(words[at], gaps, np.uint64(0)), np.insert(np.zeros(len(at), bool), gaps, True)
    return part, marks


class Items:
    """Test items as word hashes, with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int) -> None:
        hasher = WordHasher(MARKS, latin=True)
        self.ids, self.words, self.k = [], [], seed_words
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            words = hasher.long(np.frombuffer((text or "").encode(), np.uint8))
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
        self.index = {}
        for k in {min(seed_words, len(w)) for w in self.words}:
            own = [(n, np.unique(shingles(w, np.zeros(len(w), np.int8), k)[0])) for n, w in enumerate(self.words) if min(seed_words, len(w)) == k]
            hashes = np.concatenate([h for _, h in own])
            order = np.argsort(hashes, kind="stable")
            items = np.concatenate([np.full(len(h), n) for n, h in own])[order]
            unique, first = np.unique(hashes[order], return_index=True)
            present = np.zeros(1 << _FILTER_BITS, bool)
            present[unique & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.index[k] = (unique, np.append(first, len(items)), items, present)

    def seeds(self, words: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By seed length: the place in ``words`` and the row of the index of each seed found."""
        for k, (unique, _, _, present) in self.index.items():
            found, places = shingles(words, text, k)
            maybe = np.flatnonzero(present[found & np.uint64((1 << _FILTER_BITS) - 1)])
            row = np.minimum(np.searchsorted(unique, found[maybe]), len(unique) - 1)
            right = unique[row] == found[maybe]
            yield k, places[maybe[right]], row[right]

    def best(self, words: np.ndarray, seeds: list[tuple[int, np.ndarray, np.ndarray]], least: float) -> tuple[float, int | None, list[int]]:
        """Best coverage, its item, and all items of at least ``least``."""
        covered: dict[int, float] = {}
        for k, places, rows in seeds:
            _, first, items, _ = self.index[k]
            # By item, the places of its seeds; an item has a seed once, however often it occurs.
            order = np.argsort(rows, kind="stable")
            own, begin = np.unique(rows[order], return_index=True)
            by_item: dict[int, list[np.ndarray]] = {}
            for row, there in zip(own.tolist(), np.split(places[order], begin[1:]), strict=True):
                for n in items[first[row] : first[row + 1]].tolist():
                    by_item.setdefault(n, []).append(there)
            for n, there in by_item.items():
                item = self.words[n]
                part, gaps = _around(words, np.concatenate(there), k)
                marked = np.zeros(len(item), bool)
                covered[n] = tile(part, item, k, marked, gaps) / len(item)
        if not covered:
            return 0.0, None, []
        top = min(covered, key=lambda n: (-covered[n], n))
        return covered[top], self.ids[top], [self.ids[n] for n in sorted(covered) if covered[n] >= least]


class Tiler:
    """Finds the items of texts; one for each task."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int, min_coverage: float) -> None:
        self.items, self.hasher, self.least = Items(rows, seed_words), WordHasher(MARKS, latin=True), min_coverage

    def column(self, texts: pa.Array) -> list[tuple[float, int | None, list[int]]]:
        """Best coverage, its item, and all items that reach the limit, of each text."""
        found: list[tuple[float, int | None, list[int]]] = [(0.0, None, [])] * len(texts)
        for first, count, words, text in self.hasher.column(texts):
            seeds = list(self.items.seeds(words, text))
            edges = np.searchsorted(text, np.arange(count + 1))
            for doc in np.unique(np.concatenate([text[places] for _, places, _ in seeds] or [np.zeros(0, np.int64)])).tolist():
                a, b = edges[doc], edges[doc + 1]
                own = [(k, p[h] - a, r[h]) for k, p, r in seeds if (h := (p >= a) & (p < b)).any()]
                found[first + doc] = self.items.best(words[a:b], own, self.least)
        return found


def _pass(docs: DataFrame, rows: list[tuple[int, str]], seed_words: int, min_coverage: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiler = Tiler(rows, seed_words, min_coverage)
        for batch in batches:
            found = tiler.column(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([bool(x) for _, _, x in found], pa.bool_()),
                    pa.array([c for c, _, _ in found], pa.float64()),
                    pa.array([i for _, i, _ in found], pa.int64()),
                    pa.array([x for _, _, x in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "contaminated", "coverage", "item_id", "items"],
            )

    return docs.mapInArrow(run, SCHEMA)


def _items(items: DataFrame) -> tuple[DataFrame, int]:
    """The items, and an upper bound of the bytes that they take on the driver."""
    items = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return items, items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    seed_words: int = SEED_WORDS,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, contaminated, coverage, item_id and items for every row of
    ``docs`` (doc_id, text), against ``items`` (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items, size = _items(items)
    if size <= block_bytes:
        return _pass(docs, [tuple(r) for r in items.collect()], seed_words, min_coverage)
    # Rows need a number of their own for the passes to meet again.
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    blocks = 2 * (size // block_bytes + 1)
    best = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        one = materialize(_pass(docs.select(F.col("row").alias("doc_id"), "text"), [tuple(r) for r in block.collect()], seed_words, min_coverage), "tiles")
        best = one if best is None else best.unionByName(one)
    order = Window.partitionBy("doc_id").orderBy(F.desc("coverage"), F.asc_nulls_last("item_id"))
    every = F.array_sort(F.flatten(F.collect_list("items").over(Window.partitionBy("doc_id"))))
    best = best.withColumns({"items": every, "place": F.row_number().over(order)}).filter("place = 1")
    return docs.select("row", F.col("doc_id").alias("id")).join(best, F.col("row") == F.col("doc_id")).select(
        F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), "coverage", "item_id", "items"
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    seed_words: int = SEED_WORDS,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) without contamination, as
    they are; a pass for each block of items, without a shuffle."""
    items, size = _items(items)
    blocks = 1 if size <= block_bytes else 2 * (size // block_bytes + 1)
    at = docs.columns.index("text")
    for k in range(blocks):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]

        def run(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            tiler = Tiler(rows, seed_words, min_coverage)
            for batch in batches:
                yield batch.filter(pa.array([not x for _, _, x in tiler.column(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = materialize(docs, "clean") if k + 1 < blocks else docs
    return docs
