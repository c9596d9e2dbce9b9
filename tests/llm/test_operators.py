"""Each operator against a plain version, and its defined results for odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import chat_format, decontaminate, exact_dedup, line_dedup, ngram_join, pii, piece_bpe, queries, toxicity, url_filter, warc
from quillon.llm.components import connected_components
from quillon.llm.wordhash import SLICE, WordHasher

ODD = [(1, None), (2, ""), (3, "same text. "), (3, "same text. "), (None, "same text. "), (4, "Ä x " * 3000), (5, "\n\t ")]
#: Columns whose names the operators use inside.
EXTRA = "doc string, units string, class string, kept boolean, rest string"


def frame(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, "a", "b", "c", True, "e") for r in rows], f"doc_id long, text string, {EXTRA}")


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Exact dedup


@pytest.mark.parametrize(("chars", "bits"), [(4096, 64), (3, 64), (3, 2)])
def test_exact_dedup(spark, chars, bits):
    rows = [*ODD, (6, "SAME text. "), (7, "abcdefgh"), (8, "ABCDEFGH"), (9, "abcdefghi"), (10, "É"), (11, "é")]
    got = exact_dedup.exact_dedup(frame(spark, rows), chars, bits).collect()
    groups = {}
    for d, t in rows:
        key = "".join(c.lower() if c.isascii() else c for c in t or "")
        groups.setdefault(key, []).append(d)
    expected = []
    for key, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, hashlib.sha256(key.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert exact_dedup.exact_dedup(frame(spark, []).limit(0)).count() == 0


# Line dedup


def test_line_dedup(spark):
    rng = random.Random(4)
    parts = ["a b c. ", "d e. ", "x\n", "one two three four five six. ", "q q. ", "zz yy\n", "k! ", "m n o p.%% ", "\n\n", "\x01 u. "]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    for least in (6, 25):
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, docs, False), least).collect()}
        assert got == brute.line_dedup(docs, least)


def test_line_dedup_of_odd_rows(spark):
    got = line_dedup.drop_later_copies(frame(spark, ODD), 2)
    assert got.columns == ["doc_id", "text", "doc", "units", "class", "kept", "rest"]
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    # Rows without an id come first; the two rows of id 3 repeat them.
    assert found == sorted([(1, None), (2, ""), (None, "same text. "), (4, "Ä x "), (5, "\n\t ")], key=str)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


# N-gram Jaccard join


def near(text, edits, rng):
    own = text.split()
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"new{rng.randrange(9)}"
    return " ".join(own)


@pytest.mark.parametrize(("block", "short"), [(1_000_000, 128), (2_000, 8)])
def test_ngram_components(spark, monkeypatch, block, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 50 * short)
    rng = random.Random(block)
    bases = [words(rng.randint(3, 90), k, 60) for k in range(8)]
    docs = [(i, near(bases[0] if i < 150 else rng.choice(bases), rng.choice([0, 1, 1, 2, 4, 7]), rng)) for i in range(260)]
    docs += [(300, None), (301, ""), (302, "a  B"), (303, "A b"), (304, " \n"), (305, "é a b c d e f g"), (306, "É a b c d e f g")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, docs), block).collect()}
    assert got == brute.jaccard_components(docs)


def test_ngram_components_of_odd_rows(spark):
    got = sorted(map(str, map(tuple, ngram_join.ngram_components(frame(spark, ODD)).collect())))
    assert got == sorted(map(str, [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, 3), (4, 5 - 3, 4), (5, 0, 5)]))
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_search_tells_all_sizes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)]
    search = ngram_join.Search(list(range(80)), sets)
    for q in range(80):
        found = set(search.linked(sets[q]).tolist())
        expected = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[q])) >= 75 * len(np.union1d(s, sets[q]))}
        assert found == expected


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(61)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


# Words


def test_words_do_not_depend_on_slices():
    text = ("Ab cd " * 10) + "x" * (SLICE + 50) + " " + ("ef gh\n" * (SLICE // 6)) + "last"
    data = np.frombuffer(text.encode(), np.uint8)
    hasher = WordHasher()
    found = hasher.long(data)
    one = {w: hasher.long(np.frombuffer(w.encode(), np.uint8))[0] for w in ("ab", "cd", "ef", "gh", "last")}
    assert len(found) == len(text.split()) and found[-1] == one["last"]
    assert found[:2].tolist() == [one["ab"], one["cd"]] and set(found[21:-1].tolist()) == {one["ef"], one["gh"]}
    ((first, count, words_found, owner),) = WordHasher().column(pa.array(["AB cd", None, "", "ef"]))
    assert (first, count, owner.tolist()) == (0, 4, [0, 0, 3]) and words_found.tolist() == [one["ab"], one["cd"], one["ef"]]


# Decontamination


def test_tiling_against_its_definition():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        hasher = WordHasher()
        k = min(3, len(item))
        marks = np.zeros(len(item), bool)
        to = lambda x: np.array([hasher.long(np.frombuffer(w.encode(), np.uint8))[0] for w in x] or [], np.uint64)
        assert decontaminate.tile(to(doc), to(item), k, marks) == brute.tiling(doc, item, k) == sum(marks)


def test_decontaminate(spark):
    passage = words(40, 9, 10_000)
    own = passage.split()
    turned = " ".join(own[20:] + ["between"] + own[:20])
    docs = [
        (1, f"{words(300, 1)} {passage.upper()} {words(50, 2)}"),
        (2, f"{words(30, 3)} {turned}, {words(30, 4)}"),
        (3, f"{words(300, 5)} {' '.join(own[:20])}"),
        (4, words(500, 6)),
        (5, None),
        (6, ""),
        (7, passage),
        (7, passage),
        (8, "short one"),
        (9, "!!".join(own)),
    ]
    items = spark.createDataFrame([(10, passage), (11, words(30, 7, 10_000)), (12, None), (13, "short one"), (14, passage)], "item_id long, text string")
    for block in (16_000_000, 300):
        got = sorted((r.doc_id, r.contaminated, round(r.coverage, 2), r["items"]) for r in decontaminate.decontaminate(frame(spark, docs), items, block_bytes=block).collect())
        both = [10, 14]
        assert got == [
            (1, True, 1.0, both), (2, True, 1.0, both), (3, False, 0.5, []), (4, False, 0.0, []), (5, False, 0.0, []),
            (6, False, 0.0, []), (7, True, 1.0, both), (7, True, 1.0, both), (8, True, 1.0, [13]), (9, True, 1.0, both),
        ]
        kept = decontaminate.drop_contaminated(frame(spark, docs), items, block_bytes=block)
        assert len(kept.columns) == 7 and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.decontaminate(frame(spark, []), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(frame(spark, docs), items.limit(0)).collect())


# Toxicity


def test_toxicity_learns_from_errors_in_labels(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        insult = " ".join(rng.choice(["grobiku", "grobiza", "grobino", "idiot"]) for _ in range(3)) if toxic else ""
        docs.append((i, f"{words(60, i, 300)} {insult} {words(20, -i, 300)}"))
        labels.append((i, int(toxic) if rng.random() > 0.04 else int(not toxic)))
    docs += [(9000, None), (9001, ""), (9002, "grobixx! grobiyy, IDIOT."), (9003, "word " * 300_000 + "idiot grobiku")]
    given = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, docs), given)
    found = {r.doc_id: r for r in toxicity.score(frame(spark, docs), model).collect()}
    right = [found[i].predicted == int(i % 5 == 0) for i in range(700) if found[i].held_out]
    assert len(found) == 704 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values()) and found[9002].predicted == 1 and found[9001].score == found[9000].score < 0.5
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(700))
    kept = toxicity.drop_toxic(frame(spark, docs), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if not r.predicted)
    nothing = toxicity.fit(frame(spark, docs[:3]), given.limit(0))
    assert {r.score for r in toxicity.score(frame(spark, docs[:3]), nothing).collect()} == {0.5}
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs = [(i, words(30, i) + (" moron" if i % 2 else "")) for i in range(100)]
    given = [(i, i % 2) for i in range(100)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in given]
    a, b = (toxicity.fit(frame(spark, docs), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (given, turned))
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    fire = lambda on, off: np.where(truth, rng.random(4000) < on, rng.random(4000) < off)
    good, poor, other = fire(0.8, 0.02), fire(0.4, 0.3), fire(0.6, 0.05)
    votes = np.stack([good, good, poor, other, ~(good | other)], 1).astype(float)
    model = toxicity.fit_label_model(votes, np.where(good | other, 0.8, 0.1))
    odds = model.rates[:, 1] / model.rates[:, 0]
    assert odds[0] > odds[2] and odds[3] > odds[2] and odds[4] < 1
    assert model.weight[0] < 0.6 < model.weight[3]  # a voter and its copy share one voice
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.9


# Pseudonyms


def test_permutations_and_their_inverse():
    f = pii.Feistel(b"k")
    for n in (1, 2, 5, 97, 260):
        assert sorted(f.permute("x", n, i) for i in range(n)) == list(range(n))
        assert all(f.permute("x", n, f.permute("x", n, i), back=True) == i for i in range(n))
    assert f.permute("x", 10**15, 7) != pii.Feistel(b"other").permute("x", 10**15, 7)


VALUES = ["4111 1111 1111 1111", "4111111111111111", "+1 (414) 555-1791", "414-555-1791", "106.158.249.239", "123-45-6789", "2020-02-29", "31.12.1999", "12/31/1999", "DE89 3704 0044 0532 0130 00", "a.b-c@mail.example.com"]
OTHERS = ["4111 1111 1111 1112", "106.158.249.256", "000-45-6789", "2021-02-29", "DE88 3704 0044 0532 0130 00", "1.2.3.4.5", "a@b", "12345", "version 1.2.3"]


def test_pseudonyms_keep_the_format(spark):
    texts = [f"see {v}, ok" for v in VALUES + OTHERS]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, f"{VALUES[0]} and {VALUES[0]}"), (102, f"{VALUES[0]} and {VALUES[0]}"), (103, "x " * 50_000 + VALUES[6])]
    hidden = pii.pseudonymise(frame(spark, rows))
    found = {r.doc_id: r for r in hidden.collect()}
    assert [found[k].n_values for k in range(len(texts))] == [1] * len(VALUES) + [0] * len(OTHERS)
    for k, text in enumerate(texts[: len(VALUES)]):
        assert found[k].text != text and re.sub(r"[a-z]", "a", re.sub(r"\d", "9", found[k].text)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text)) or "106." in text
        span = found[k].spans[0]
        assert text[span.start : span.end] == VALUES[k]
        again = pii.Pseudonyms(pii.KEY).apply(found[k].text)[1]
        assert [x[0] for x in again] == [span.kind]  # still valid
    one, two = found[102].text.split(" and ")
    assert one == two == found[0].text.removeprefix("see ").removesuffix(", ok")
    assert found[100].text is None and found[101].text == "" and hidden.count() == len(rows)
    back = {r.doc_id: r.text for r in pii.restore(hidden).collect()}
    assert all(back[d] == t for d, t in rows)
    assert pii.pseudonymise(frame(spark, [])).count() == 0


# Pieces


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_path(queries.PIECES)


def test_pieces_are_the_librarys(model):
    table = piece_bpe.PieceTable(model)
    rng = random.Random(5)
    alphabet = ["a", "b", "e", "t", "h", " ", "  ", "the", "in", "\n", "é", "日", "☃", "▁", "\0", ".", "1", "ing", "ßü", "\t", "😀", "Q", "   ", "</s>", "<0x0A>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * 30_000, " " * 999, "ab" * 9000 + "日" * 50]
    assert [ids for ids, _ in table.encode_all(texts)] == table.model.encode(texts, add_eos=True)


def test_piece_queries(spark, model):
    got = piece_bpe.piece_digests(frame(spark, ODD), model)
    table = piece_bpe.PieceTable(model)
    expected = []
    for d, t in ODD:
        ids = table.model.encode(t or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), table.model.decode(ids))]
        expected.append((d, len(ids), *sha))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    texts = piece_bpe.decode_pieces(piece_bpe.encode_pieces(frame(spark, ODD), model), model)
    assert sorted(r.text for r in texts.collect()) == sorted(t or "" for _, t in ODD)
    assert piece_bpe.piece_digests(frame(spark, []), model).count() == 0


# Chats


def test_chat_escapes_are_reversible():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "### ", "</turn>", ": ", "#", "a", "\n"]) for _ in range(rng.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not re.search(r"(?<!\\)(?:\\\\)*(?:### |</turn>)", chat_format.escape(text))


def test_chats(spark):
    import public_tokenizers

    path, pattern = queries.tokenizer_path(queries.TOKENS), public_tokenizers.PATTERN
    text = queries.EXTRA_TEXT
    turns = [(1, 1, "assistant", text), (1, 0, "user", text), (1, 2, "assistant", None), (2, 0, None, "x " * 150_000), (3, 5, "a: ### b", "é\n"), (3, 5, "a: ### b", "é\n"), (None, 0, "assistant", "")]
    data = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, input_ids string, place int")
    formatted = chat_format.format_turns(data, path, pattern)
    for conv in (1, 3):
        own = sorted((r for r in formatted.collect() if r.conv_id == conv), key=lambda r: r.place)
        assert [r.token_start for r in own] == [sum(len(x.input_ids) for x in own[:k]) for k in range(len(own))]
    got = {r.conv_id: r for r in chat_format.conversation_digests(formatted, path, pattern).collect()}
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\nassistant\n\n") and got[1].n_turns == 3
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(text), sha(text)) and got[2].loss_chars == 0
    assert got[3].turns_sha256 == sha("a: ### b\né\n\n" * 2) and got[None].n_turns == 1 and len(got) == 4
    assert chat_format.conversation_digests(chat_format.format_turns(data.limit(0), path, pattern), path, pattern).count() == 0


# URLs


def test_urls(spark):
    urls = {
        "http://A.Example.com/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://xexample.com/en/7": ("xexample.com", "/en/7", "com/en/", "block"),
        "https://b.example.net/de/80#a": ("b.example.net", "/de/80", "example.net/de/8", "block"),
        "https://b.example.net/de/": ("b.example.net", "/de/", "net/de/", "allow"),
        "https://org/es": ("org", "/es", None, "allow"),
        "x://org?/es/": ("org", "", None, "allow"),
        "https://b.org/es//": ("b.org", "/es//", "org/es/", "block"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://org/es/", "h")] * 2
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: (r[0] is None, r[0]))] == [*urls.values(), *[("org", "/es/", "org/es/", "block")] * 2]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# WARC


def test_warc(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" * 100
    pages = [(1, "http://a/x?q#f", big), (2, "http://b", big), (3, "http://c/\r\nX: y", "small"), (4, None, "small"), (5, "u", None), (2, "http://b", big), (None, "n", big), (6, "l", "z" * 70_000)]
    frame_of_pages = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_warc(frame_of_pages, f"file://{tmp_path}/w")
    captures = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w")).collect()
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    got = sorted((str(c.metadata.page_id), c.response.kind, c.metadata.refers_to, c.response.digest, bytes(c.response.payload or b"")) for c in captures)
    html = {str(p): (h or "") for p, _, h in pages}
    expected = sorted((str(p), "revisit" if p in (1, None) else "response", 2 if p in (1, None) else None, sha(h or ""), b"" if p in (1, None) else (h or "").encode()) for p, _, h in pages)
    assert got == expected and len(html) == 7
    assert all(c.request.record_id and c.metadata.payload_length == len(html[str(c.metadata.page_id)].encode()) for c in captures)
    warc.write_warc(frame_of_pages.limit(0), f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"HTTP/1.1 200 OK\r\n"))


def test_sql_of_queries_is_there():
    assert set(queries.oracle_sql()) == {"op3_exact_dedup", "op4_chat_format", "op6_url_filter", "op10_warc"} <= set(queries.queries())
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
