"""Encoding with a merge-type (BPE) piece vocabulary by a table over prefixes.

For every prefix of a text the encoding ends with one certain piece, whatever
follows. The table holds that piece for each prefix: of the pieces that end
there (the matches of an automaton over the vocabulary) it is the one that is
compatible with the last piece of the prefix before it, that is, both together
are encoded as just these two. The ids are then read off backwards. This takes
time in proportion to the text's length, also for one huge word.

No piece crosses the start of a word (checked when the vocabulary is loaded),
so tables are kept by word, in a cache of bounded size that lasts as long as
the worker process. New words are read side by side, as arrays. Characters
without a piece become byte pieces.

Defined results: null text counts as empty and has the end id only; repeated
rows come out repeated; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

SPACE = "▁"
#: Words in the cache and bits of its slots; bits of the slots of the table of pairs.
WORDS, WORD_BITS, PAIR_BITS = 500_000, 20, 20
#: Words of more bytes are kept in a dict, shorter ones as two numbers.
SHORT, PROBES = 15, 8
#: Stands for the start of a word in place of a piece; ids are smaller.
SHIFT = 20
START = (1 << SHIFT) - 1
#: Words of more characters are read one by one, others side by side.
LONG = 200
#: Rows and bytes of text that are encoded at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1_500_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, input_ids array<int>"
#: Where a worker process keeps its tables from task to task, by path.
KEPT = "_quillon_piece_tables"


def piece_table(path: str) -> PieceTable:
    """The table of a vocabulary, which this process makes once. (Functions are
    pickled by value, so a global of this module would be new in every task.)"""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if path not in kept:
        kept[path] = PieceTable(path)
    return kept[path]


class PieceTable:
    """A vocabulary, its automaton and the compatibility of its pieces."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.model.eos_id()
        n = self.model.get_piece_size()
        if n >= START:
            raise ValueError(f"more than {START} pieces")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.id[piece], self.score[piece] = i, self.model.get_score(i)
        self.characters = {c for piece in self.id for c in piece}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id):
            raise ValueError("a piece crosses the start of a word")
        if "\0" in self.characters:
            raise ValueError("a piece holds the character that separates words here")
        # A line break has no piece in most vocabularies: it is a word of its own then.
        self.breaks = "\n" not in self.characters
        some = "[^" + re.escape("".join(sorted(self.characters))) + "]"
        self.unknown = re.compile(f"({some})")
        self.known_text = self.characters.issuperset
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in self.id.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.piece = {i: piece for piece, i in self.id.items()}
        counts = Counter(self.score.values())
        #: Pieces that share a score have no certain time of birth among themselves.
        self.tied = {piece for piece, score in self.score.items() if counts[score] > 1}
        self._arrays(n)
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.decimal = np.array([f"{i} ".ljust(8).encode() for i in range(n)], "S8").view(np.uint8).reshape(n, 8)
        self.decimals = np.array([len(f"{i} ") for i in range(n)])
        self.words = Words()

    def _arrays(self, n: int) -> None:
        """By id: length, time of birth, the two parts of the last merge, and whether
        the piece comes out when it is encoded by itself; by pair of ids: the score of both together."""
        self.length, self.born = np.zeros(n, np.int64), np.full(n, np.inf)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.alone, self.is_tied = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        pairs = {}
        for piece, i in self.id.items():
            self.length[i], self.is_tied[i] = len(piece), piece in self.tied
            halves = self.merged(piece, 2) if len(piece) > 1 else [piece]
            self.alone[i] = len(halves) == 2 or len(piece) == 1
            if len(piece) > 1:
                self.born[i] = self.score[piece]
            if len(halves) == 2:
                self.left[i], self.right[i] = self.id[halves[0]], self.id[halves[1]]
            for k in range(1, len(piece)):
                a, b = self.id.get(piece[:k]), self.id.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = self.score[piece]
        self.both_keys = np.array(sorted(pairs), np.int64)
        self.both_score = np.array([pairs[k] for k in self.both_keys.tolist()])

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """The encoding of a short text by its definition: the pair with the
        best score merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > down_to:
            best = None
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of pieces, whether no merge ever crosses their border. Time runs
        backwards: of the two parts at the border, the one made later (of
        equals, the right one) is taken apart. A merge of both happens if its
        turn comes before either part goes into a larger one."""
        out = np.zeros(len(left), bool)
        at = np.arange(len(left))
        left_end, right_end = np.full(len(left), -np.inf), np.full(len(left), -np.inf)
        while len(at):
            key = left << SHIFT | right
            k = np.minimum(np.searchsorted(self.both_keys, key), len(self.both_keys) - 1)
            both = self.both_score[k]
            go = ~((self.both_keys[k] == key) & (both > left_end) & (both >= right_end))
            made_left, made_right = self.born[left], self.born[right]
            done = np.isinf(made_left) & np.isinf(made_right)
            out[at[go & done]] = True
            go &= ~done
            by_right = (made_right <= made_left)[go]
            at, left, right = at[go], left[go], right[go]
            left_end = np.where(by_right, left_end[go], made_left[go])
            right_end = np.where(by_right, made_right[go], right_end[go])
            left, right = np.where(by_right, left, self.right[left]), np.where(by_right, self.left[right], right)
        return out

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether the second piece of each pair can follow the first (or, for START, can be first)."""
        before, piece = keys >> SHIFT, keys & START
        fits = self.alone[piece]
        some = np.flatnonzero(fits & (before != START))
        left, right = before[some], piece[some]
        fits[some] = self._stay_apart(left, right)
        for k in np.flatnonzero(self.is_tied[left] | self.is_tied[right]).tolist():
            own = [self.piece[int(left[k])], self.piece[int(right[k])]]
            fits[some[k]] = self.merged("".join(own)) == own
        return fits

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """``_compatible``, by a table that keeps the last pair of each slot."""
        slot = (keys * 0x9E3779B97F4A7C1 >> 18) & ((1 << PAIR_BITS) - 1)
        known = self.pair_keys[slot] == keys
        out = self.pair_fits[slot] & known
        if not known.all():
            new, where = np.unique(keys[~known], return_inverse=True)
            fits = self._compatible(new)
            out[~known] = fits[where]
            slot = (new * 0x9E3779B97F4A7C1 >> 18) & ((1 << PAIR_BITS) - 1)
            self.pair_keys[slot] = -1
            self.pair_keys[slot], self.pair_fits[slot] = new, fits
            # Of several new pairs with one slot the last stays, in both tables.
        return out

    def _matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of every piece in ``text``: the end of its place, and its id."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        return found[:, 0] + 1, found[:, 1]

    def _last_pieces(self, joined: str, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last piece of every prefix of the words in ``joined``, by the
        prefix's end. Prefixes of one length are filled side by side, as each
        depends on shorter ones of its word alone, and one match fits at most."""
        last = np.full(len(joined) + 2, -1, np.int64)
        last[starts] = START
        end, piece = self._matches(joined)
        begin, size = end - self.length[piece], end - np.repeat(starts, sizes + 1)[end - 1]
        order = np.argsort(size.astype(np.int16), kind="stable")
        end, piece, begin = end[order], piece[order], begin[order]
        edges = np.cumsum(np.bincount(size, minlength=1))
        for a, b in zip(edges, edges[1:], strict=False):
            before = last[begin[a:b]]
            some = np.flatnonzero(before >= 0) + a
            some = some[self._fits(last[begin[some]] << SHIFT | piece[some])]
            last[end[some]] = piece[some]
        return last

    def _side_by_side(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all of whose characters have pieces."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        last = self._last_pieces("\0".join(words), starts, sizes)
        # Backwards from the ends; step k finds the k-th id from behind.
        at, who, steps = starts + sizes, np.arange(len(words)), []
        while len(who := who[at[who] > starts[who]]):
            piece = last[at[who]]
            if (piece < 0).any():
                raise ValueError(f"no piece ends a prefix of {words[int(who[piece < 0][0])][:40]!r}")
            at[who] -= self.length[piece]
            steps.append((who, piece))
        counts = np.zeros(len(words), np.int64)
        for who, _ in steps:
            counts[who] += 1
        edges = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(edges[-1], np.int64)
        for k, (who, piece) in enumerate(steps):
            flat[edges[who + 1] - 1 - k] = piece
        ids, edges = flat.tolist(), edges.tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _long(self, word: str) -> list[int]:
        """The same for one long word, prefix by prefix."""
        last, pairs = [-1] * (len(word) + 1), {}
        last[0] = START
        for end, piece in self.automaton.iter(word):
            before = last[end + 1 - len(self.piece[piece])]
            if before < 0 or last[end + 1] >= 0:
                continue
            key = before << SHIFT | piece
            if key not in pairs:
                pairs[key] = bool(self._fits(np.array([key]))[0])
            if pairs[key]:
                last[end + 1] = piece
        ids, left = [], len(word)
        while left:
            if last[left] < 0:
                raise ValueError(f"no piece ends the prefix of {left} characters of {word[:40]!r}")
            ids.append(last[left])
            left -= len(self.piece[last[left]])
        return ids[::-1]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts within words, all of whose characters have pieces."""
        short = self._side_by_side([t for t in texts if len(t) <= LONG])
        source = iter(short)
        return [next(source) if len(t) <= LONG else self._long(t) for t in texts]

    def _learn(self, words: list[str]) -> list[list[int]]:
        """Ids of words of any characters."""
        parts = [[w] if self.known_text(w) else self.unknown.split(w) for w in words]  # texts and unknown characters in turn
        texts = iter(self._ids([t for p in parts for t in p[::2]]))
        out = []
        for own in parts:
            ids = next(texts)
            for c in own[1::2]:
                ids += [self.bytes[b] for b in c.encode()]
                ids += next(texts)
            out.append(ids)
        return out

    def _split(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin: at texts, at the first of adjacent blanks, and at and after line breaks."""
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[starts] = True
        if self.breaks:
            line = data == 10
            begins |= line
            begins[1:] |= line[:-1]
        return np.flatnonzero(begins)

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the edges between texts."""
        raw = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
        sizes = np.array([0, *map(len, raw)])
        starts, whole = np.cumsum(sizes), b"".join(raw)
        data = np.frombuffer(whole + bytes(16), np.uint8)
        begin = self._split(data[: len(whole)], starts[:-1][sizes[1:] > 0])
        size = np.diff(np.append(begin, len(whole)))
        found = self.words.find(whole, data, begin, size, lambda words: self._learn([w.decode().replace(" ", SPACE) for w in words]))
        at, count = self.words.at[found], self.words.count[found]
        sums = np.concatenate([[0], np.cumsum(count)])
        ids = self.words.ids[np.repeat(at - sums[:-1], count) + np.arange(sums[-1])]
        ends = sums[np.searchsorted(begin, starts[1:])]
        return np.insert(ids, ends, self.end), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])

    def encode(self, text: str) -> list[int]:
        return self.encode_arrays([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Of each text, all ids with the end id, and the same as decimals with spaces between."""
        ids, edges = self.encode_arrays(texts)
        lists = [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)]
        return [(own, d.decode()) for own, d in zip(lists, self.decimals_of(ids, edges), strict=True)]

    def decimals_of(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """Of each text, the ids as decimals with one space between."""
        sizes = self.decimals[ids]
        joined = self.decimal[ids][np.arange(8) < sizes[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[edges].tolist()
        return [joined[a : b - 1] for a, b in zip(at, at[1:], strict=False)]


class Words:
    """The ids of the words seen last. Short words are keys of two numbers,
    compared as a whole, in an array of slots; long ones are in a dict."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.key_a, self.key_b = np.zeros(1 << WORD_BITS, np.uint64), np.zeros(1 << WORD_BITS, np.uint64)
        self.value = np.zeros(1 << WORD_BITS, np.int32)
        self.long: dict[bytes, int] = {}
        self.n = self.n_ids = 0
        self.at, self.count, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)

    def add(self, found: list[list[int]]) -> np.ndarray:
        """Numbers of new words with these ids."""
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        while self.n + len(counts) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        own = np.arange(self.n, self.n + len(counts))
        self.at[own], self.count[own] = self.n_ids + np.cumsum(counts) - counts, counts
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n, self.n_ids = self.n + len(counts), self.n_ids + len(flat)
        return own

    def _slots(self, a: np.ndarray, b: np.ndarray, probe: int) -> np.ndarray:
        x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(64 - WORD_BITS)).astype(np.int64) + probe) & ((1 << WORD_BITS) - 1)

    def find(self, whole: bytes, data: np.ndarray, begin: np.ndarray, size: np.ndarray, learn: Callable[[list[bytes]], list[list[int]]]) -> np.ndarray:
        """The number of each word of ``data``; new ones are learnt."""
        if self.n > WORDS:
            self.clear()
        out = np.full(len(begin), -1, np.int64)
        short = np.flatnonzero(size <= SHORT)
        at, n = begin[short], size[short]
        eight = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1)).view("<u8")[:, 0]
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        a = eight[at] & masks[np.minimum(n, 8)]
        b = eight[at + 8] & masks[np.maximum(n - 8, 0)] | (n.astype(np.uint64) << np.uint64(56))
        left = np.arange(len(short))
        for probe in range(PROBES):
            slot = self._slots(a[left], b[left], probe)
            hit = (self.key_a[slot] == a[left]) & (self.key_b[slot] == b[left])
            out[short[left[hit]]] = self.value[slot[hit]]
            left = left[~hit]
        if len(left):
            order = left[np.lexsort((a[left], b[left]))]
            new = np.ones(len(order), bool)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            first = order[new]
            own = self.add(learn([whole[i : i + k] for i, k in zip(at[first].tolist(), n[first].tolist(), strict=True)]))
            out[short[order]] = own[np.cumsum(new) - 1]
            for probe in range(PROBES):
                slot = self._slots(a[first], b[first], probe)
                free, which = np.unique(slot, return_index=True)
                which = which[self.key_b[free] == 0]
                slot = slot[which]
                self.key_a[slot], self.key_b[slot], self.value[slot] = a[first[which]], b[first[which]], own[which]
                rest = np.ones(len(first), bool)
                rest[which] = False
                first, own = first[rest], own[rest]
        others = np.flatnonzero(size > SHORT)
        words = [whole[i : i + k] for i, k in zip(begin[others].tolist(), size[others].tolist(), strict=True)]
        if new := list(set(words).difference(self.long)):
            self.long.update(zip(new, self.add(learn(new)).tolist(), strict=True))
        out[others] = [self.long[w] for w in words]
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, input_ids): the ids of every row of ``docs`` (doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model_path)
        for batch in _slices(batches):
            ids, edges = pieces.encode_arrays([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "input_ids"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, IDS_SCHEMA)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, input_ids), by the library's decoder."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in _slices(batches):
            texts = [model.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "input_ids").mapInArrow(decode, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode, decode, and return the digests of both, one row per document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model_path)
        for batch in _slices(batches):
            ids, edges = pieces.encode_arrays([t or "" for t in batch.column(1).to_pylist()])
            ids_hex = [hashlib.sha256(d).hexdigest() for d in pieces.decimals_of(ids, edges)]
            lists = [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)]
            text_hex = [hashlib.sha256(pieces.model.decode(own).encode()).hexdigest() for own in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(edges), pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digests, SCHEMA)
