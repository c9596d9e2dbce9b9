"""64-bit hashes of the words of many texts at once, with numpy.

A word's hash is a polynomial over random byte values modulo 2**64, taken from
prefix sums (as Karp and Rabin's), then mixed; a word of more than ``LONG``
bytes has a BLAKE2 digest, as such polynomials agree by construction on some
pairs of long words (Thue and Morse's). Texts are handled in slices of bounded
size that end between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
#: Bytes of a word from which on its hash is a digest.
LONG = 64
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public splitmix constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _random(n: int, seed: int) -> np.ndarray:
    step = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(step + U64(seed))


_BYTE = _random(256, 11)
BASE = int(_random(1, 12)[0]) | 1
INVERSE = pow(BASE, -1, 1 << 64)
_PLACE = _random(8, 13) | U64(1)
_SHORT = _random(8, 14)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Word ends: space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Word ends: all of ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _digest(word: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")


class WordHasher:
    """Hashes of the words of texts. ``separators``: which bytes end words.
    ``latin``: fold the case of the letters of Latin-1, too."""

    def __init__(self, separators: np.ndarray = SPACES, latin: bool = False) -> None:
        self.separators, self.latin = separators, latin
        self.power, self.inverse = powers(BASE, SLICE + 1), powers(INVERSE, SLICE + 1)

    def _fold(self, data: np.ndarray) -> np.ndarray:
        folded = _FOLD[data]
        if self.latin and len(data) > 1:
            after = data[1:]
            upper = (data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
            folded[1:][upper] += 0x20
        return folded

    def _raw(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and unmixed hash of each word of a slice, and its prefix sums; ``starts`` of texts end words, too."""
        inside = ~self.separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        edge[len(data)] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[self._fold(data)] * self.power[: len(data)], out=sums[1:])
        return begin, end, (sums[end] - sums[begin]) * self.inverse[begin], sums

    def group(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of adjacent texts of at most SLICE bytes together, and the text of each."""
        begin, end, raw, _ = self._raw(data, starts)
        text = np.searchsorted(starts, begin, "right") - 1
        return self._whole(data, begin, end, raw), text

    def _whole(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Hashes of whole words from their polynomials."""
        hashes = mix(raw + (end - begin).astype(U64))
        for k in np.flatnonzero(end - begin > LONG).tolist():
            hashes[k] = _digest(self._fold(data[begin[k] : end[k]]))
        return hashes

    def features(self, data: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Of adjacent texts: hashes of all words, and for each length of the
        beginnings of so many bytes of longer words; and the text of each."""
        begin, end, raw, sums = self._raw(data, starts)
        text = np.searchsorted(starts, begin, "right") - 1
        size = end - begin
        hashes, texts = [self._whole(data, begin, end, raw)], [text]
        for n in lengths:
            longer = np.flatnonzero(size > n)
            at = begin[longer]
            hashes.append(mix((sums[at + n] - sums[at]) * self.inverse[at] + U64(n << 32)))
            texts.append(text[longer])
        return np.concatenate(hashes), np.concatenate(texts)

    def _pieces(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """A text in pieces of at most SLICE bytes that end between words, and
        whether a piece is one word that is longer than that."""
        at = 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            one = False
            if end < len(data):
                ends = np.flatnonzero(self.separators[data[at:end]])
                one = not len(ends)
                end = self._word_end(data, end) if one else at + int(ends[-1]) + 1
            yield data[at:end], one and end - at > SLICE
            at = end

    def long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of one text of any size."""
        parts = [np.zeros(0, U64)]
        for piece, one in self._pieces(data):
            parts.append(np.array([_digest(self._fold(piece))], U64) if one else self.group(piece, np.zeros(1, np.int64))[0])
        return np.concatenate(parts)

    def long_features(self, data: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
        """``features`` of one text of any size."""
        parts = [np.zeros(0, U64)]
        for piece, one in self._pieces(data):
            own = self.features(piece[:SLICE], np.zeros(1, np.int64), lengths)[0]
            if one:  # the first is of the whole word, the others are of its beginnings
                own[0] = _digest(self._fold(piece))
            parts.append(own)
        return np.concatenate(parts)

    def _word_end(self, data: np.ndarray, at: int) -> int:
        """Where the word that goes on at ``at`` ends."""
        while at < len(data):
            ends = np.flatnonzero(self.separators[data[at : at + SLICE]])
            if len(ends):
                return at + int(ends[0])
            at += SLICE
        return len(data)

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Over a column of strings, in groups of adjacent rows: first row,
        number of rows, hashes of all their words, and the row of each."""
        for first, count, data, starts in groups(texts):
            if len(data) > SLICE:
                hashes = self.long(data)
                yield first, count, hashes, np.zeros(len(hashes), np.int64)
            else:
                yield first, count, *self.group(data, starts)


def groups(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Adjacent rows of at most ``limit`` bytes together (or one longer row):
    first row, number of rows, bytes, and where each row starts. Null is empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last - first, data[offsets[first] : offsets[last]], (offsets[first:last] - offsets[first])
        first = last


def shingles(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and where each begins."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = words[:n] * _PLACE[0]
    for j in range(1, k):
        total = total + words[j : n + j] * _PLACE[j]
    whole = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(total[whole] + _SHORT[k % 8]), whole
