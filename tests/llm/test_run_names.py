"""Line dedup: names of runs, and the steps that are written on the way."""

from __future__ import annotations

import random

import brute

from quillon.llm import line_dedup


def test_runs_have_one_name_exactly_if_they_are_equal(spark):
    rng = random.Random(3)
    rows = [(doc, stretch, k, rng.randrange(3)) for doc in range(4) for stretch in range(3) for k in range(100 * stretch, 100 * stretch + rng.randint(1, 20))]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc long, stretch long, start long, key long, units long, words long")
    by_place = {r[:3]: r[3] for r in rows}
    ahead, behind = {}, {}
    for r in line_dedup.run_names(frame, 25).collect():
        assert len(r.ahead) == len(r.behind) == 5
        for k in range(5):
            for side, names, places in (("ahead", ahead, range(r.start, r.start + 2**k)), ("behind", behind, range(r.start - 2**k + 1, r.start + 1))):
                run = tuple(by_place.get((r.doc, r.stretch, p)) for p in places)
                if None in run:
                    assert r[side][k] is None
                else:
                    names.setdefault(run, set()).add(r[side][k])
    assert ahead == behind and all(len(names) == 1 for names in ahead.values())
    assert len({tuple(names) for names in ahead.values()}) == len(ahead) > 100


def test_doubling_writes_no_step_of_its_own(spark, monkeypatch):
    """Each length was written and joined anew once."""
    rng, written = random.Random(5), []
    real = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: written.append(label) or real(df, label))
    pool = [f"w{k} w{rng.randrange(9)}. " for k in range(40)]
    docs = [(k, "".join([pool[(5 * k + j) % 40] for j in range(30)] + [f"own{k} x{j}. " for j in range(3)])) for k in range(12)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 25).collect()}
    assert got == brute.line_dedup(docs, 25) and got != dict(docs)
    assert len(written) <= 8
