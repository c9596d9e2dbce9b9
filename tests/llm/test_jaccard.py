"""The n-gram Jaccard join: rows without id, groups in which all hangs together, confusable words."""

from __future__ import annotations

import random
import time

import brute
import numpy as np
import pytest

from quillon.llm import ngram_join


def edited(text, k, rng):
    own = text.split()
    for _ in range(k):
        own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_links_run_through_rows_without_id(spark, block):
    rng = random.Random(2)
    base = " ".join(f"w{k}" for k in range(80))
    chain = [base]
    for _ in range(7):
        chain.append(edited(chain[-1], 1, rng))
    rows = [(k + 1 if k % 2 == 0 else None, t) for k, t in enumerate(chain)] + [(None, chain[1]), (None, "alone a b c d e f g"), (None, "alone a b c d e f g"), (None, None)]
    rows += [(90, edited(base, 40, rng)), (90, edited(base, 40, rng)), (91, chain[0]), (91, chain[0]), (91, chain[6])]
    rng.shuffle(rows)
    numbered = dict(enumerate(rows))
    links = brute.jaccard_components([(k, t) for k, (_, t) in numbered.items()])
    smallest: dict[int, list[int]] = {}
    for k, (d, _) in numbered.items():
        smallest.setdefault(links[k][1], []).extend([] if d is None else [d])
    expected = sorted(str((d, links[k][0], min(smallest[links[k][1]], default=None))) for k, (d, _) in numbered.items())
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), block).collect()
    assert sorted(str(tuple(r)) for r in got) == expected


def test_words_that_polynomials_confuse_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    rows = [(k, " ".join([w] * 9 + [f"x{j}" for j in range(3)])) for k, w in ((1, a), (2, b), (3, a))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_block_in_which_all_hangs_together_takes_seconds():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 60, 7).astype(np.uint64))
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 60, k % 2).astype(np.uint64))) for k in range(60_000)]
    began = time.time()
    links = ngram_join.Search(list(range(len(sets))), sets).within()
    assert len(links) == len(sets) - 1 and time.time() - began < 60


def test_a_loose_block_agrees_with_all_pairs():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 60, 30).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(common)[: rng.integers(5, 30)], rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(300)]
    found = ngram_join.Search(list(range(300)), sets).within()
    pairs = [(i, j) for i in range(300) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]

    def roots(edges):
        root = list(range(300))
        for _ in range(300):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(found) == roots(pairs)
