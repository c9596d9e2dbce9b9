"""The pipeline's stages, and all of it, against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import brute
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from quillon.llm import piece_bpe, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_rows string"


def prose(n, rng):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    passage, exam = prose(60, rng), prose(40, rng)
    docs = [(k, prose(rng.randint(5, 160), rng)) for k in range(160)]
    docs = [(k, f"{t} {rng.choice(['scum idiot moron', 'stupid vermin idiot', 'moron trash scum'])} {prose(5, rng)}" if k % 4 == 0 else t) for k, t in docs]
    docs += [(200 + k, f"{prose(30, rng)}. {passage} {prose(30, rng)}") for k in range(5)]
    base = prose(120, rng).split()
    docs += [(300 + k, " ".join(w if rng.random() > 0.004 else "new" + str(rng.randrange(99)) for w in base)) for k in range(12)]
    docs += [(400 + k, f"{prose(40, rng)} {exam} {prose(40, rng)}") for k in range(4)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "la " * 4000), (505, "one two"), (None, prose(20, rng)), (506, prose(50, rng))]
    docs += [docs[-1], (506, prose(50, rng))]
    rows = [(d, t, "en", "s", len(t or ""), "x") for d, t in docs]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 1, int(d % 4 == 0)) for d, _ in docs if d is not None and d < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, exam), (2, prose(30, rng)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, exam


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_each_stage_against_a_plain_version(spark, tables):
    folder, exam = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    found = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    toxic = {r.doc_id for r in found if r.predicted}
    after = stages["toxicity"](spark, docs, folder)
    assert rows_of(after) == sorted(((d, t) for d, t in rows_of(docs) if d not in toxic), key=str)
    assert {d for d, _ in rows_of(docs)} - {d for d, _ in rows_of(after)} >= {d for d in range(0, 160, 4)} - {0} and 1 not in toxic

    after = corpus_pipeline.materialize(after, "t")
    before = sorted(rows_of(after), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    plain = brute.line_dedup([(n, t or "") for n, (_, t) in enumerate(before)], 25)
    expected = []
    for n, (d, t) in enumerate(before):
        if t is None or plain[n] == t or plain[n].strip():
            expected.append((d, None if t is None else plain[n]))
    lines = stages["line dedup"](spark, after, folder)
    assert rows_of(lines) == sorted(expected, key=str) and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)

    lines = corpus_pipeline.materialize(lines, "t")
    numbered = list(enumerate(rows_of(lines)))
    links = brute.jaccard_components([(n, t) for n, (_, t) in numbered])
    groups: dict[int, list] = {}
    for n, (d, t) in numbered:
        groups.setdefault(links[n][1], []).append((d, t))
    expected = set()
    for own in groups.values():
        smallest = min((d for d, _ in own if d is not None), default=None)
        expected |= {(d, t) for d, t in own if d == smallest}
    near = stages["n-gram Jaccard join"](spark, lines, folder)
    assert rows_of(near) == sorted(expected, key=str) and near.columns == docs.columns

    near = corpus_pipeline.materialize(near, "t")
    items = [exam, *[r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.item_id == 2]]

    def words(text):
        return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()

    def clean(text):
        return all(brute.tiling(words(text), words(i), 5) < 0.75 * len(words(i)) for i in items)

    left = stages["benchmark decontamination"](spark, near, folder)
    assert rows_of(left) == sorted(((d, t) for d, t in rows_of(near) if clean(t)), key=str)
    # The first copy of the passage; line dedup has cut the later ones.
    assert 400 in {d for d, _ in rows_of(near)} and 400 not in {d for d, _ in rows_of(left)}

    left = corpus_pipeline.materialize(left, "t")
    model = piece_bpe.PieceTable(queries.tokenizer_path(queries.PIECES)).model
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for d, t in rows_of(left):
        ids = model.encode(t or "", add_eos=True)
        expected.append(str((d, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))))
    pieces = stages["SentencePiece encoding and decoding"](spark, left, folder)
    assert sorted(str(tuple(r)) for r in pieces.collect()) == sorted(expected)
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(expected)


def test_empty_tables_and_missing_columns(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    few = spark.createDataFrame([(1, "a b c d e f. " * 9, 3), (2, "a b c d e f. " * 9, 4), (2, "z y x", 5), (2, "z y x", 4)], "doc_id long, text string, count int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        few = corpus_pipeline.materialize(stage(spark, few, str(tmp_path) if name == "benchmark decontamination" else folder), "few")
        assert few.columns == ["doc_id", "text", "count"]
    assert sorted(map(tuple, few.collect())) == [(1, "a b c d e f. ", 3), (2, "z y x", 4)]
