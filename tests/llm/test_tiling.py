"""Decontamination of long, repetitive and reordered texts, against the definition of greedy string tiling."""

from __future__ import annotations

import random
import time

import brute
import numpy as np

from quillon.llm import decontaminate
from quillon.llm.wordhash import SLICE, WordHasher


def own(n, name):
    return " ".join(f"{name}{k}" for k in range(n))


def found(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.coverage, r.item_id, r.contaminated) for r in decontaminate.decontaminate(docs, items, **more).collect()}


def test_tiling_of_random_texts_of_few_words(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))) for k in range(12)]
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for k in range(40)]
    for blocks in ({}, {"block_bytes": 400}):
        got = found(spark, docs, items, seed_words=3, min_coverage=0.6, **blocks)
        for d, text in docs:
            covered = {n: brute.tiling(text.split(), t.split(), min(3, len(t.split()))) / len(t.split()) for n, t in items}
            best = max(covered.values())
            expected = (best, min(n for n in covered if covered[n] == best) if best else None, best >= 0.6)
            assert got[d] == expected


def test_a_passage_counts_once_in_a_document_of_any_length(spark):
    passage = own(40, "p")
    items = [(1, f"{passage} x {passage} y")]
    docs = [(1, f"{own(300, 'a')} {passage} {own(300, 'b')}"), (2, f"{own(150_000, 'a')} {passage} {own(150_000, 'b')}"), (3, f"{passage} {own(210_000, 'a')} {passage}")]
    got = found(spark, docs, items)
    assert got[1][0] == got[2][0] == 40 / 82 and got[3] == (80 / 82, 1, True)


def test_reordered_passages(spark):
    passage = own(60, "p").split()
    turned = [*passage[40:], "q", *passage[20:40], "r", *passage[:20]]
    got = found(spark, [(1, " ".join([own(20, "a"), *turned])), (2, " ".join(passage[:30] + passage[:30]))], [(7, " ".join(passage))])
    assert got == {1: (1.0, 7, True), 2: (0.5, 7, False)}


def test_repeated_words_take_no_longer():
    doc, item = np.full(10**6, 5, np.uint64), np.full(400, 5, np.uint64)
    began = time.time()
    marked = np.zeros(400, bool)
    assert decontaminate.tile(doc, item, 5, marked) == 400
    assert decontaminate.tile(np.tile(np.array([5, 6, 7], np.uint64), 300_000), item, 5, np.zeros(400, bool)) == 0
    assert time.time() - began < 20


def test_repetitive_documents(spark):
    docs = [(1, "la " * 1_000_000), (2, "la li " * 100_000), (3, "la " * 300)]
    assert found(spark, docs, [(1, "la " * 400), (2, "la li " * 50)]) == {1: (1.0, 1, True), 2: (1.0, 2, True), 3: (0.75, 1, True)}


def test_long_words_that_polynomials_confuse():
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    hasher = WordHasher()
    hashes = hasher.long(np.frombuffer(f"{a} {b} {a} x".encode(), np.uint8))
    assert hashes[0] == hashes[2] != hashes[1]
    far = "y " * (SLICE // 2) + "z" * (SLICE + 9) + " " + a
    assert hasher.long(np.frombuffer(far.encode(), np.uint8))[-1] == hashes[0]


def test_features_of_long_texts_do_not_depend_on_slices(monkeypatch):
    from quillon.llm import wordhash

    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdeÉ") for _ in range(rng.choice([1, 5, 9, 70, 300]))) for _ in range(400)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = WordHasher().features(data, np.zeros(1, np.int64), (4, 8))[0]
    monkeypatch.setattr(wordhash, "SLICE", 100)
    small = WordHasher()
    assert sorted(small.long_features(data, (4, 8)).tolist()) == sorted(whole.tolist())
    assert small.long(data).tolist() == WordHasher().long(data).tolist() and len(small.long(data)) == 400
