"""Line dedup by what it must find, whatever the units are: passages anywhere in a line."""

from __future__ import annotations

import random

import pytest

from quillon.llm import line_dedup

WIDE = "".join(map(chr, (0x3002, 0xFF01, 0xFF1F)))


def texts(spark, docs, least=25):
    return {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()}


def own(n, name):
    return " ".join(f"{name}{k}" for k in range(n))


@pytest.mark.parametrize("stop", [". ", "! ", "? ", "; ", "?! ", '!" ', *WIDE, chr(0x964) + " "])
def test_every_sentence_end_ends_a_unit(spark, stop):
    passage = "".join(own(10, f"s{k}x") + stop for k in range(6))
    docs = [(k, own(8, f"a{k}") + stop + passage + own(8, f"b{k}")) for k in (1, 2)]
    got = texts(spark, docs)
    assert got[1] == docs[0][1] and got[2] == own(8, "a2") + stop + own(8, "b2")


def test_units_join_to_the_text(spark):
    rng = random.Random(9)
    signs = [".", "!", "?", ";", " ", "\n", "a", "b", "\t", "\x01", "\x02", chr(0xE000), chr(0xA0), WIDE[0], chr(0x2026), '"', "."]
    rows = [("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))),) for _ in range(400)] + [("." * 5000,), ("!-" * 9000 + "x",)]
    frame = spark.createDataFrame(rows, "text string")
    assert all("".join(r.u) == r.text for r in frame.select("text", line_dedup.units(frame["text"]).alias("u")).collect())


def test_words_are_runs_without_white_space(spark):
    odd = ["", "a", "a  b", "a\tb c", " a b ", "a" + chr(0xA0) + "b", chr(0x3000), "x\r\ny", chr(0x4E00) * 3 + "ab " + chr(0xE9), "\x0b", "a" + chr(0x2003) + "b."]
    frame = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r.n for r in frame.select(line_dedup.n_words(frame.t).alias("n")).collect()] == [0, 1, 2, 3, 2, 2, 0, 2, 5, 0, 2]


@pytest.mark.parametrize("space", ["\t", chr(0xA0), chr(0x2003), "  "])
def test_repeated_lines_with_other_spaces(spark, space):
    line = space.join(own(60, "w").split()) + "\n"
    got = texts(spark, [(1, "a\n" + line + "b"), (2, "c\n" + line + "d")])
    assert got == {1: "a\n" + line + "b", 2: "c\nd"}


def test_blanks_are_no_words(spark):
    docs = [(k, f"head {k}\nTotal" + " " * 30 + "12\nend") for k in (1, 2, 3)]
    assert texts(spark, docs) == dict(docs)


def test_letters_that_stand_alone_are_words(spark):
    line = "".join(chr(0x4E00 + k) for k in range(60)) + WIDE[0]
    assert texts(spark, [(1, "a. " + line), (2, "b. " + line)])[2] == "b. "


def runs(text, n):
    """(start, words) of the runs of ``n`` words."""
    split = text.split()
    return [(k, tuple(split[k : k + n])) for k in range(len(split) - n + 1)]


def test_passages_of_51_to_60_words_at_any_place(spark):
    rng = random.Random(6)
    docs, pasted = [], []
    for k in range(120):
        size = 51 + k % 10
        stops = {rng.randrange(size) for _ in range(rng.choice([0, 1, 3, 8]))}
        passage = " ".join(f"p{k}w{rng.randrange(30)}" + ("." if j in stops else "") for j in range(size))
        around = [" ".join(f"d{rng.randrange(10**9)}" for _ in range(rng.randint(0, 40))) for _ in range(4)]
        docs += [(2 * k, f"{around[0]} {passage} {around[1]}"), (2 * k + 1, f"{around[2]} {passage} {around[3]}")]
        pasted.append((size, around[2], around[3]))
    got = texts(spark, docs)
    for k, (size, before, after) in enumerate(pasted):
        assert got[2 * k] == docs[2 * k][1]
        left = got[2 * k + 1].split()
        assert len(left) <= size - 25 + len(before.split()) + len(after.split())
        assert left[: len(before.split())] == before.split() and left[len(left) - len(after.split()) :] == after.split()


def test_all_long_runs_are_found_and_nothing_else_goes(spark):
    """By word runs, without units: every later run of 2 n + 1 words loses n; each word that goes is in an earlier run of n."""
    rng, n = random.Random(12), 6
    pool = [[f"w{rng.randrange(25)}" + rng.choice(["", "", "", ".", "?"]) for _ in range(rng.randint(5, 40))] for _ in range(12)]
    docs = []
    for k in range(60):
        split = [w for _ in range(rng.randint(1, 4)) for w in [*rng.choice(pool)[rng.randint(0, 4) :], *(f"f{rng.randrange(10**6)}" for _ in range(rng.randint(0, 5)))]]
        docs.append((k, " ".join(split)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    cut = {r.doc_id: r for r in line_dedup.line_dedup(frame, n).collect()}
    units = {r.doc_id: r.u for r in frame.select("doc_id", line_dedup.units(frame["text"], line_dedup._most(n)).alias("u")).collect()}
    seen, many = {}, 0
    for d, text in docs:
        row, gone = cut[d], set()
        edges = [0]
        for unit in units[d]:
            edges.append(edges[-1] + len(unit.split()))
        for start, end in row.cuts:
            gone |= set(range(edges[start], edges[end]))
        assert row.text.split() == [w for k, w in enumerate(text.split()) if k not in gone]
        for k, run in runs(text, n):
            seen.setdefault(run, (d, k))
        again = {j for k, run in runs(text, n) if seen[run] < (d, k) for j in range(k, k + n)}
        assert gone <= again
        for k, run in runs(text, 2 * n + 1):
            if seen.setdefault(run, (d, k)) < (d, k):
                assert len(gone & set(range(k, k + 2 * n + 1))) >= n
                many += 1
    assert many > 100


def test_texts_of_too_many_units_are_refused(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "STRIDE", 8)
    assert texts(spark, [(1, "a\n" * 8)]) == {1: "a\n" * 8}
    with pytest.raises(Exception, match="more than 8 units"):
        texts(spark, [(1, "a\n" * 9)])
