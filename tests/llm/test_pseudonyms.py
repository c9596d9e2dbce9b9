"""Pseudonyms against a plain version: values by trying every kind at every place, one after the other."""

from __future__ import annotations

import random
import re
import time

from quillon.llm import pii

VALUES = [
    "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "378282246310005", "(212) 555-0187", "+1 212-555-0187", "112-555-0187",
    "078-05-1120", "666-05-1120", "192.168.0.1", "192.168.0.300", "1.2.3.4.5", "2024-02-29", "2023-02-29", "31.12.1999", "12/31/1999", "31/12/1999",
    "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "a.b+c@example.co.uk", "x@y", '"' + "0f" * 20 + '"', "2024-02-29 4111111111111111",
]


def plain(text: str, feistel: pii.Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """Every kind in turn; a find that overlaps one of before is none. Letters are marked one by one."""
    owner = [None] * len(text)
    found = []
    for kind, pattern, permute in pii.KINDS:
        for m in re.finditer(pattern, text):
            if any(owner[k] for k in range(*m.span())):
                continue
            new = permute(feistel, m[0], False)
            if new is not None:
                owner[m.start() : m.end()] = [kind] * (m.end() - m.start())
                found.append((m.start(), m.end(), kind, new))
    out = text
    for start, end, _, new in sorted(found, reverse=True):
        out = out[:start] + new + out[end:]
    return out, [(kind, start, end) for start, end, kind, _ in sorted(found)]


def test_values_are_those_of_the_plain_version(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice([*VALUES, " ", ", ", "\n", "no 7 ", "é", "1", "."]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    rows = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    feistel = pii.Feistel(pii.KEY)
    expected = {k: plain(t, feistel) for k, t in enumerate(texts)}
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans], r.n_values) for r in pii.pseudonymise(rows).collect()}
    assert got.pop(None) == (None, [], 0)
    assert got == {k: (t, spans, len(spans)) for k, (t, spans) in expected.items()}
    assert sum(len(s) for _, s in expected.values()) > 500


def test_equal_values_stay_linked_and_others_apart(spark):
    days = [f"{1900 + k // 365}-{1 + k % 12:02}-{1 + k % 28:02}" for k in range(3000)]
    rows = spark.createDataFrame([(k, f"on {d} and {d}.") for k, d in enumerate(days)], "doc_id long, text string")
    pairs = {}
    for r in pii.pseudonymise(rows).collect():
        a, b = re.findall(r"\d{4}-\d\d-\d\d", r.text)
        assert a == b
        pairs.setdefault(days[r.doc_id], set()).add(a)
    assert all(len(new) == 1 for new in pairs.values())
    assert len({min(new) for new in pairs.values()}) == len(pairs)


def test_long_texts_with_many_values_take_no_longer():
    text = " ".join(f"192.168.{k % 250}.{k % 199}, 2024-02-{1 + k % 28:02}" for k in range(100_000))
    began = time.time()
    assert len(pii.Pseudonyms(b"k").apply(text)[1]) == 200_000 and time.time() - began < 60
