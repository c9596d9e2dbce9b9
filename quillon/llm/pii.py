"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Values that pass their own check (Luhn, IBAN remainder, dates of the calendar,
numbering plans, octets) are mapped by a keyed permutation of all values of the
same format, so equal values get equal pseudonyms in every document, different
values different ones, and a pseudonym passes the same check. The permutation
is a Feistel network over the integers below the format's size; its rounds are
keyed BLAKE2b, and results outside the domain go round again (cycle walking).
With the key it can be undone (``restore``).

It runs where the rows are: no shuffle, one pass, whole texts.

Defined results: null text stays null, with no values; empty text stays empty;
repeated rows come out repeated; overlapping finds go to the kind named first
in KINDS; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The default key is public: give a secret one for data that is handed on.
KEY = b"quillon pseudonyms"
ROUNDS = 8
SCHEMA = "doc_id long, text string, n_values long, spans array<struct<kind:string,start:int,end:int>>"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
MEMORY = 100_000


class Feistel:
    """Keyed permutations of range(size), another one for each label."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, label: str, size: int, k: int, half: int) -> int:
        data = f"{label}|{size}|{k}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _pass(self, label: str, size: int, value: int, back: bool) -> int:
        width = isqrt(size - 1) + 1
        left, right = divmod(value, width)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - self._round(label, size, k, left)) % width, left
            else:
                left, right = right, (left + self._round(label, size, k, right)) % width
        return left * width + right

    def permute(self, label: str, size: int, value: int, back: bool = False) -> int:
        if size < 2:
            return value
        while True:
            value = self._pass(label, size, value, back)
            if value < size:
                return value


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in text)


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 if k % 2 else 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = str(f.permute("card", 10 ** (len(digits) - 1), int(digits[:-1]), back)).zfill(len(digits) - 1)
    return _refill(text, body + str(luhn(body)))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """North American numbers: area and exchange are from 200."""
    digits = _digits(text)
    own = digits[-10:]
    area, exchange, line = int(own[:3]), int(own[3:6]), int(own[6:])
    if area < 200 or exchange < 200 or digits[:-10] not in ("", "1"):
        return None
    n = f.permute("phone", 800 * 800 * 10_000, ((area - 200) * 800 + exchange - 200) * 10_000 + line, back)
    rest, line = divmod(n, 10_000)
    area, exchange = divmod(rest, 800)
    return _refill(text, f"{digits[:-10]}{area + 200}{exchange + 200}{line:04}")


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in octets):
        return None
    n = f.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"), back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    area -= area > 666
    n = f.permute("ssn", 898 * 99 * 9999, ((area - 1) * 99 + group - 1) * 9999 + serial - 1, back)
    rest, serial = divmod(n, 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area + 1 >= 666)
    return f"{area:03}-{group + 1:02}-{serial + 1:04}"


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    """The body is permuted, digits within digits and letters within letters."""
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if _iban_check(country, body) != int(check):
        return None
    body = _by_class(f, f"iban {country}", body, back)
    new = iter(f"{country}{_iban_check(country, body):02}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _by_class(f: Feistel, label: str, text: str, back: bool) -> str:
    """Digits are permuted within digits, letters a-z within letters of the
    same case; the case pattern and other characters stay."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    shape = "".join("9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else c for c in low)
    size, n = 1, 0
    for c, kind in zip(low, shape, strict=True):
        if kind in "9a":
            base = 10 if kind == "9" else 26
            size, n = size * base, n * base + (ord(c) - (48 if kind == "9" else 97))
    n = f.permute(f"{label} {shape}", size, n, back)
    out = []
    for c, kind in zip(reversed(text), reversed(shape), strict=True):
        if kind in "9a":
            n, k = divmod(n, 10 if kind == "9" else 26)
            new = chr(k + (48 if kind == "9" else 97))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(reversed(out))


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """The local part is permuted; the domain stays."""
    local, _, domain = text.rpartition("@")
    return f"{_by_class(f, 'email ' + domain.lower(), local, back)}@{domain}"


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    """Credentials in hexadecimal, within numbers of as many digits."""
    new = format(f.permute("secret", 16 ** len(text), int(text, 16), back), f"0{len(text)}x")
    return new.upper() if text.isupper() else new


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """Dates of 1900 to 2099: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy."""
    parts = re.split("[-./]", text)
    sign = text[len(parts[0])]
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if sign == "/" else (2, 1, 0)
    try:
        day = datetime.date(*(int(parts[k]) for k in order)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + f.permute("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY, back))
    values = (new.year, new.month, new.day)
    return sign.join(str(values[order.index(k)]).zfill(4 if order[0] == k else 2) for k in range(3))


#: Kind, pattern and permutation; the first that fits at a place is tried first.
KINDS: tuple[tuple[str, str, Callable[[Feistel, str, bool], str | None]], ...] = (
    ("email", r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w@])", _email),
    ("secret", r"""(?<=")(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,128}(?=")""", _secret),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)", _iban),
    ("phone", r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<!\w)\+1[0-9]{10}(?!\w)", _phone),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-])", _date),
    ("ip", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])", _ip),
    ("card", r"(?<![\w-])(?<![0-9][./])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])", _card),
)
_PATTERNS = [(kind, re.compile(pattern), permute) for kind, pattern, permute in KINDS]
_ANY = re.compile("[0-9]|@")


class Pseudonyms:
    """Finds values in texts and replaces them; a bounded memory keeps recent ones."""

    def __init__(self, key: bytes) -> None:
        self.feistel = Feistel(key)
        self.memory: dict[tuple[str, str, bool], str | None] = {}

    def value(self, kind: str, permute: Callable, text: str, back: bool) -> str | None:
        at = (kind, text, back)
        if at not in self.memory:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[at] = permute(self.feistel, text, back)
        return self.memory[at]

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text, and (kind, start, end) of each value by its place in the old one."""
        if not _ANY.search(text):
            return text, []
        taken: list[tuple[int, int, str, str]] = []  # in order, without overlaps
        for kind, pattern, permute in _PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            starts, found = [t[0] for t in taken], []
            for m in pattern.finditer(text):
                k = bisect_left(starts, m.end())
                if k and taken[k - 1][1] > m.start():
                    continue
                new = self.value(kind, permute, m[0], back)
                if new is not None:
                    found.append((m.start(), m.end(), kind, new))
            taken = sorted(taken + found) if found else taken
        out, at = [], 0
        for start, end, _, new in taken:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [(kind, start, end) for start, end, kind, _ in taken]


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_values and spans (places in the input
    text, in characters) for every row of ``docs`` (doc_id, text)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            rows = [(None, []) if t is None else names.apply(t, back) for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in found] for _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array(map(len, spans), pa.int64()), pa.array(spans, pa.list_(span))],
                ["doc_id", "text", "n_values", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def restore(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Undo ``pseudonymise`` with the same key."""
    return pseudonymise(docs, key, back=True)
