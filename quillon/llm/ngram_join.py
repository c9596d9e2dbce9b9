"""N-gram Jaccard join by T-occurrence search, down to connected components.

A document is its set of distinct word shingles. Documents with one set are one
class; what follows is between classes.

1. Inverted lists. Shingles have a total order: those frequent in the corpus
   come last, the rest by hash. Which are called frequent only decides the
   order: those that are in a slice of documents, and those that are listed
   more than ``MOVE`` times when lists are made to be counted only. Two sets with a Jaccard value of 3/4 share one
   of the first n - ceil(3n/4) + 1 shingles of either, so only those are
   listed, with the set's size. The rows are dealt by shingle and stream by in
   order of size.
2. Candidates. A list of up to ``SHORT`` sets gives its pairs of fitting sizes;
   they are counted over all lists, and pairs below the number of common listed
   shingles that 3/4 demands are out. A longer list gives edges from each size
   class to its first set, so that all sets of fitting sizes hang together.
   Connected components of these edges are the clusters: every link lies
   within one.
3. T-occurrence search in a cluster, with whole sets, in blocks of at most
   ``BLOCK_TOKENS``: for a set, DivideSkip merges its short lists with a heap,
   probes its long ones by binary search, and keeps the sets that reach the
   overlap. These leave the lists and are searched with next, so a block in
   which all hangs together is done after as many short searches as it has
   sets. A cluster of several blocks is searched in
   each block together with some sets that all its blocks get; then those not
   connected with the largest part are searched in all blocks. So no link
   between parts is lost. (A cluster of several blocks in which little is linked
   costs a copy of its sets to each of its blocks.)
4. Connected components of the links found.

Shingles and classes are told apart by 64-bit hashes (BLAKE2 for classes): of n
different sets about n**2 / 2**65 pairs are confused, 3 of 10**10 documents.

Defined results: null or empty text, or white space alone: no shingles, a
component of its own; fewer than five words: the whole sequence is the one
shingle; repeated rows come out repeated; a null doc_id takes part but is never
the smallest; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import connected_components
from .wordhash import WordHasher, shingles

WORDS = 5
#: The limit of the contract: 100 * intersection >= 75 * union.
PERCENT = 75
SHORT = 128
#: Shingles listed more often come last in the order; lists are counted SURVEYS times for that.
MOVE, SURVEYS = 16, 2
BLOCK_TOKENS = 1_000_000
#: Shingles in this share of documents and above may come last in the order.
FREQUENT = 0.0005
#: So many of them at most (the most frequent): they go to every task.
MAX_FREQUENT = 1_000_000
#: A slice of documents in which shingles are counted has so many shingles.
SLICE_TOKENS, SLICE_COUNT = 2_000_000, 4
#: Sets that all blocks of a large cluster get.
SHARED_SETS = 64
#: Weight of the long lists in DivideSkip's choice.
MU = 0.01

SET_SCHEMA = "kind int, doc_id long, n long, class long, token long, count long"
LIST_SCHEMA = "token long, n long, class long"
PAIR_SCHEMA = "a long, b long, n_a long, n_b long, common long, many boolean"
LINK_SCHEMA = "a long, b long"


def word_sets(texts: pa.Array, hasher: WordHasher) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each row, in lists of adjacent rows."""
    for _, count, words, text in hasher.column(texts):
        found, places = shingles(words, text, WORDS)
        owner = text[places]
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
        edges = np.searchsorted(owner, np.arange(count + 1))
        spans = np.searchsorted(text, np.arange(count + 1))
        out = []
        for k in range(count):
            own = words[spans[k] : spans[k + 1]]
            if 0 < len(own) < WORDS:
                out.append(shingles(own, np.zeros(len(own), np.int8), len(own))[0])
            else:
                out.append(found[edges[k] : edges[k + 1]])
        yield out


def _class(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def document_sets(docs: DataFrame) -> DataFrame:
    """Of each row (kind 0): doc_id, n and class. Of each slice of documents
    (kind 1): shingles that are frequent there, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= SLICE_COUNT
            tokens, n = tokens[often].view(np.int64), int(often.sum())
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), nothing, nothing, nothing, pa.array(tokens), pa.array(counts[often])],
                [x.split()[0] for x in SET_SCHEMA.split(", ")],
            )

        for batch in batches:
            sets = [s for part in word_sets(batch.column(1), hasher) for s in part]
            n = len(sets)
            yield _batch([[0] * n, batch.column(0).to_pylist(), [len(s) for s in sets], [_class(s) for s in sets], [None] * n, [None] * n], SET_SCHEMA)
            for s in sets:
                held.append(s)
                size += len(s)
                if size >= SLICE_TOKENS:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, SET_SCHEMA)


def listed(n: int) -> int:
    """How many shingles of a set of ``n`` are listed."""
    return n - ceil(PERCENT * n / 100) + 1


def inverted_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, n, class): the listed shingles of each set. A task lists a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            for sets in word_sets(batch.column(1), hasher):
                tokens, sizes, classes = [], [], []
                for s in sets:
                    if not len(s) or (own := _class(s)) in seen:
                        continue
                    seen.add(own)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        last = frequent[at] == s
                        s = np.concatenate([s[~last], s[last]])
                    tokens.append(s[: listed(len(s))])
                    sizes.append(len(s))
                    classes.append(own)
                counts = [len(t) for t in tokens]
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.repeat(np.array(sizes, np.int64), counts)),
                            pa.array(np.repeat(np.array(classes, np.int64), counts)),
                        ],
                        ["token", "n", "class"],
                    )

    return docs.mapInArrow(run, LIST_SCHEMA)


def _size_class(n: np.ndarray) -> np.ndarray:
    """Sets of fitting sizes (ratio 3/4 and above) are in one class or in two adjacent ones."""
    return np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)


class _Lists:
    """Takes rows sorted by token, size and class, and makes candidates of each list."""

    def __init__(self) -> None:
        self.out: list[tuple[np.ndarray, ...]] = []

    def short(self, n: np.ndarray, c: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """All pairs of fitting sizes in the lists that begin at ``first``; step by step for all lists at once."""
        for step in range(1, SHORT):
            own = size > step
            first, size = first[own], size[own]
            if not len(first):
                break
            counts = size - step
            left = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            right = left + step
            fits = (n[left] * 100 >= n[right] * PERCENT) & (c[left] != c[right])
            self._add(n[left[fits]], c[left[fits]], n[right[fits]], c[right[fits]], False)

    def _add(self, n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray, many: bool) -> None:
        if len(a):
            swap = a > b
            self.out.append(
                (np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b), np.full(len(a), many))
            )

    def long(self, n: np.ndarray, c: np.ndarray, before: tuple[int, int, int] | None) -> tuple[int, int, int]:
        """Part of a long list; ``before``: size class, size and set of the last size class begun."""
        kind = _size_class(n)
        begins = np.ones(len(n), bool)
        begins[1:] = kind[1:] != kind[:-1]
        if before is not None:
            begins[0] = kind[0] != before[0]
        heads = np.flatnonzero(begins)
        head_kind, head_n, head_c = kind[heads], n[heads], c[heads]
        if before is not None:
            head_kind, head_n, head_c = (np.concatenate([[x], y]) for x, y in zip(before, (head_kind, head_n, head_c), strict=True))
        group = np.cumsum(begins) - (before is None)
        self._add(head_n[group], head_c[group], n, c, True)
        near = np.flatnonzero(np.diff(head_kind) == 1)
        self._add(head_n[near], head_c[near], head_n[near + 1], head_c[near + 1], True)
        return int(head_kind[-1]), int(head_n[-1]), int(head_c[-1])

    def flush(self) -> pa.RecordBatch:
        """Candidates so far, equal ones counted."""
        parts = [np.concatenate(x) for x in zip(*self.out, strict=True)] if self.out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        self.out = []
        a, b, n_a, n_b, many = parts
        keep = a != b
        a, b, n_a, n_b, many = (x[keep] for x in (a, b, n_a, n_b, many))
        order = np.lexsort((many, b, a))
        a, b, n_a, n_b, many = (x[order] for x in (a, b, n_a, n_b, many))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (many[1:] != many[:-1])
        at = np.flatnonzero(new)
        common = np.diff(np.append(at, len(a)))
        names = [x.split()[0] for x in PAIR_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], n_a[at], n_b[at], common, many[at])], names)


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common, many) from the inverted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        kept: list[np.ndarray] | None = None  # rows of the list that may go on
        before: tuple[int, int, int] | None = None  # set if that list is long and partly done
        token_open: int | None = None
        for batch in batches:
            token, n, c = (batch.column(k).to_numpy() for k in range(3))
            if kept is not None:
                token, n, c = (np.concatenate([x, y]) for x, y in zip(kept, (token, n, c), strict=True))
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (c[1:] == c[:-1])
            token, n, c = token[~same], n[~same], c[~same]
            if not len(token):
                continue
            begins = np.ones(len(token), bool)
            begins[1:] = token[1:] != token[:-1]
            first = np.flatnonzero(begins)
            size = np.diff(np.append(first, len(token)))
            rest = int(first[-1])
            if token_open is not None and int(token[0]) != token_open:
                before = None
            for k in np.flatnonzero(size[:-1] > SHORT).tolist() + ([0] if before is not None and len(first) > 1 and size[0] <= SHORT else []):
                span = slice(first[k], first[k] + size[k])
                lists.long(n[span], c[span], before if k == 0 else None)
            small = (size[:-1] > 1) & (size[:-1] <= SHORT)
            if before is not None and len(first) > 1:
                small[0] = False
            lists.short(n, c, first[:-1][small], size[:-1][small])
            if len(first) > 1:
                before = None
            token_open = int(token[rest])
            if before is not None or size[-1] > SHORT:
                # The list is long: what is here is done, its last row stays to tell repeated rows.
                before = lists.long(n[rest:], c[rest:], before)
                rest = len(token) - 1
            kept = [token[rest:].copy(), n[rest:].copy(), c[rest:].copy()]
            if sum(len(x[0]) for x in lists.out) >= 200_000:
                yield lists.flush()
        if kept is not None:
            token, n, c = kept
            if before is not None:
                lists.long(n, c, before)
            elif len(token) > 1:
                lists.short(n, c, np.zeros(1, np.int64), np.array([len(token)]))
        yield lists.flush()

    return rows.repartition("token").sortWithinPartitions("token", "n", "class").mapInArrow(run, PAIR_SCHEMA)


class Search:
    """T-occurrence search over the sets of one block that are still open."""

    def __init__(self, classes: list[int], sets: list[np.ndarray]) -> None:
        self.classes, self.sets = classes, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.postings, self.owned = owner[order], tokens[order]
        self.open = np.ones(len(sets), bool)
        self._index()

    def _index(self) -> None:
        """The inverted lists of the open sets, each in order of the sets."""
        left = self.open[self.postings]
        self.postings, self.owned = self.postings[left], self.owned[left]
        begins = np.ones(len(self.owned), bool)
        begins[1:] = self.owned[1:] != self.owned[:-1]
        first = np.flatnonzero(begins)
        self.tokens, self.first = self.owned[first], np.append(first, len(self.owned))
        self.indexed = int(self.open.sum())

    def _list(self, token: int) -> np.ndarray:
        own = self.postings[self.first[token] : self.first[token + 1]]
        return own[self.open[own]]

    def linked(self, query: np.ndarray) -> np.ndarray:
        """Open sets that reach the overlap with ``query``: its short lists are
        merged with a heap, those that can still reach it are looked up in the
        long ones by binary search."""
        nothing, n = np.zeros(0, np.int64), len(query)
        least = ceil(PERCENT * n / 100)
        if not len(self.tokens):
            return nothing
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < least:
            return nothing
        lengths = self.first[at + 1] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        skipped = min(int(least / (MU * log2(max(2, int(lengths.max()))) + 1)), least - 1)
        short, long = at[: len(at) - skipped], at[len(at) - skipped :]
        lists = [own for t in short.tolist() if len(own := self._list(t))]
        merged = np.fromiter(heapq.merge(*(own.tolist() for own in lists)), np.int64)
        ends = np.flatnonzero(np.append(np.diff(merged) != 0, True)) if len(merged) else nothing
        found, common = merged[ends], np.diff(ends, prepend=-1)
        sizes = self.sizes[found]
        fits = (common >= least - skipped) & (sizes * 100 >= n * PERCENT) & (n * 100 >= sizes * PERCENT)
        found, common = found[fits], common[fits]
        for k, t in enumerate(long.tolist()):
            own = self.postings[self.first[t] : self.first[t + 1]]
            common = common + (own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found)
            reach = common >= least - (len(long) - k - 1)
            found, common = found[reach], common[reach]
            if not len(found):
                return nothing
        return found[100 * common >= PERCENT * (n + self.sizes[found] - common)]

    def within(self) -> list[tuple[int, int]]:
        """Spanning links of the block's own sets. What a search finds is closed
        and searched with next, so every set is found once, and lists get
        shorter as the block gets connected."""
        links = []
        for first in range(len(self.sets)):
            queue = [first] if self.open[first] else []
            self.open[first] = False
            while queue:
                q = queue.pop()
                if 2 * int(self.open.sum()) < self.indexed:
                    self._index()
                found = self.linked(self.sets[q])
                self.open[found] = False
                links += [(self.classes[q], self.classes[k]) for k in found.tolist()]
                queue += found.tolist()
        return links

    def across(self, labels: list[int], query: np.ndarray, own: int, label: int) -> list[tuple[int, int]]:
        """A link of ``query`` with each other label that it has one with."""
        done = {label}
        links = []
        for k in self.linked(query).tolist():
            if labels[k] not in done:
                done.add(labels[k])
                links.append((own, self.classes[k]))
        return links


BLOCK_SCHEMA = "cluster long, block long, query boolean, label long, class long, tokens binary"


MEMBER_SCHEMA = "cluster long, blocks long, block long, shared boolean, class long, tokens binary"


def _with_sets(docs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """MEMBER_SCHEMA: the members, each with its set from a text of its class:
    that of the row ``rep``, or, where no row of the class has an id, any."""
    names = [x.split()[0] for x in MEMBER_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [s for part in word_sets(batch.column(len(names)), hasher) for s in part]
            rows = [*(batch.column(k) for k in range(len(names) - 1)), pa.array([s.tobytes() for s in sets], pa.binary()), batch.column(len(names) - 1)]
            # Another text may have the same doc_id.
            own = [_class(s) == c for s, c in zip(sets, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(rows, [*names, "again"]).filter(pa.array(own, pa.bool_()))

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for found in word_sets(batch.column(0), hasher):
                yield _batch([[_class(s) for s in found], [s.tobytes() for s in found]], "class long, tokens binary")

    # An id that repeats may have one text several times.
    again = sets.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again"))
    # Not by broadcast, also where it would do: the members grow with the documents.
    known = members.withColumnRenamed("rep", "doc_id").filter("doc_id is not null").join(again.hint("merge"), "doc_id", "left")
    known = known.withColumn("again", F.coalesce("again", F.lit(False)))
    rows = docs.join(known.hint("merge"), "doc_id").select(*names[:-1], "again", "text").mapInArrow(run, MEMBER_SCHEMA + ", again boolean")
    unknown = members.filter("rep is null").select(*names[:-1])
    texts = docs.filter("doc_id is null").select("text").mapInArrow(own_sets, "class long, tokens binary")
    first = texts.join(unknown.select("class").hint("merge"), "class", "left_semi").groupBy("class").agg(F.first("tokens").alias("tokens"))
    once = rows.filter("not again").drop("again").unionByName(unknown.join(first.hint("merge"), "class"))
    return once.unionByName(rows.filter("again").drop("again").dropDuplicates(["class"]))


def block_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) found in each block of ``rows``; with queries only those of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: list[tuple]) -> pa.RecordBatch:
            index = [r for r in block if not r[0]]
            queries = [r for r in block if r[0]]
            links: list[tuple[int, int]] = []
            if len(index) > 1 or (queries and index):
                search = Search([r[2] for r in index], [np.frombuffer(r[3], np.uint64) for r in index])
                if queries:
                    for _, label, own, tokens in queries:
                        links += search.across([r[1] for r in index], np.frombuffer(tokens, np.uint64), own, label)
                else:
                    links = search.within()
            return _batch([[a for a, _ in links], [b for _, b in links]], LINK_SCHEMA)

        key, block = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for cluster, part, *row in zip(*columns, strict=True):
                if (cluster, part) != key:
                    if block:
                        yield done(block)
                    key, block = (cluster, part), []
                block.append(tuple(row))
        if block:
            yield done(block)

    ordered = rows.select(*[x.split()[0] for x in BLOCK_SCHEMA.split(", ")]).repartition("cluster", "block")
    return ordered.sortWithinPartitions("cluster", "block", "query", "class").mapInArrow(run, LINK_SCHEMA)


def _tokens(often: DataFrame) -> np.ndarray:
    """Sorted shingles of (token, count): all, or the MAX_FREQUENT most frequent.
    Those left out only come earlier in the order; no result depends on it."""
    own = often.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    return np.sort(own.column(0).to_numpy().view(np.uint64))


def ngram_components(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead
    to) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    first = materialize(document_sets(docs), "sets")
    sets = first.filter("kind = 0").select("doc_id", "n", "class")
    often = first.filter("kind = 1").groupBy("token").agg(F.sum("count").alias("count"))
    least = max(2.0, FREQUENT * sets.count())
    # At most average size / FREQUENT shingles are as frequent as that, at any number of documents.
    frequent = _tokens(often.filter(F.col("count") >= least))
    for _ in range(SURVEYS):
        counted = inverted_rows(docs, frequent).select("token").groupBy("token").agg(F.count(F.lit(1)).alias("count"))
        counted = materialize(counted.filter(F.col("count") > MOVE), "long-lists")
        frequent = np.union1d(frequent, _tokens(counted))
        release(counted)

    pairs = candidates(inverted_rows(docs, frequent)).groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"),
        F.sum(F.when(F.col("many"), 0).otherwise(F.col("common"))).alias("common"), F.max("many").alias("many"),
    )

    def rest(n: str) -> F.Column:
        return F.ceil(F.col(n) * PERCENT / 100) - 1

    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * PERCENT / (100 + PERCENT))
    needed = overlap - F.greatest(rest("n_a"), rest("n_b"))
    edges = pairs.filter(F.col("many") | (F.col("common") >= needed)).select("a", "b")
    clusters = connected_components(edges).select(F.col("node").alias("class"), F.col("label").alias("cluster"))

    classes = sets.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    plain = members = materialize(clusters.join(classes, "class"), "members")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("sets"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("weight") / block_tokens).cast("long"))
    members = members.join(sizes, "cluster")
    members = members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    every = F.greatest((F.col("sets") / SHARED_SETS).cast("long"), F.lit(1))
    shared = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class", F.lit(1)), every) == 0)
    whole = materialize(_with_sets(docs, sets, members.withColumn("shared", shared)), "member-sets")
    release(plain)
    members = whole
    no = F.lit(False).alias("query"), F.lit(0).cast("long").alias("label")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    rows = members.filter("not shared").select("cluster", "block", *no, "class", "tokens")
    rows = rows.unionByName(members.filter("shared").select("cluster", everywhere, *no, "class", "tokens"))
    links = materialize(block_links(rows), "links")
    done = [whole, links]
    if not members.filter("blocks > 1").isEmpty():
        # Every set gets a label here, also one that has no link yet.
        known = connected_components(links).select(F.col("node").alias("class"), "label")
        large = members.filter("blocks > 1").join(known, "class", "left").withColumn("label", F.coalesce("label", "class"))
        large = materialize(large, "large-clusters")
        done.append(large)
        parts = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("size"))
        main = parts.groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
        queries = large.join(main, "cluster").filter("label <> main")
        rows = large.select("cluster", "block", F.lit(False).alias("query"), "label", "class", "tokens").unionByName(
            queries.select("cluster", everywhere, F.lit(True).alias("query"), "label", "class", "tokens")
        )
        # A block without queries has nothing to find; its rows would be searched within.
        asked = queries.select("cluster").distinct()
        done.append(materialize(block_links(rows.join(asked, "cluster", "left_semi")), "links"))
        links = links.unionByName(done[-1])
    found = connected_components(links)
    release(*done)
    labels = found.select(F.col("node").alias("class"), "label")
    classes = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = classes.join(smallest, "label").select("class", "component_id")
    some = sets.filter("n > 0").join(classes, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)
