"""Registered queries, where the operators' tests do not reach."""

from __future__ import annotations

import glob
import os
import random
import time

import duckdb
import pytest

from quillon.llm import chat_format, piece_bpe, queries, toxicity, url_filter, warc


def test_warc_query_assembles_payloads(spark, tmp_path, monkeypatch):
    pages = [(1, "http://a.b/c", "x" * 1200), (2, "http://a.b/d", "x" * 1200), (3, "http://a.b/e", None), (4, None, "\u00e9")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seen, assemble = [], warc.assemble
    monkeypatch.setattr(warc, "assemble", lambda *a, **k: seen.append(assemble(*a, **k)) or seen[-1])
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in queries.op10_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (1200, "revisit", 2), 2: (1200, "response", None), 3: (0, "response", None), 4: (2, "response", None)}
    assert "payload" in seen[0].schema["response"].dataType.names


def test_toxicity_fits_all_features_of_long_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"{(k * 9000 + j) * 7919:x}word" for j in range(9000))) for k in range(1, 9)], "doc_id long, text string")
    given = []
    monkeypatch.setattr(toxicity, "train", lambda rows: given.extend(rows))
    toxicity.fit(docs, docs.selectExpr("doc_id", "1 AS toxic"))
    texts = docs.filter(~toxicity.held_out(docs.doc_id)).select("text").toArrow().column(0).combine_chunks()
    whole = [int((rows == k).sum()) for _, n, rows, _ in toxicity.text_features(texts) for k in range(n)]
    assert sorted(len(f) for _, f in given) == sorted(whole) and min(whole) > 8000


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    ours, theirs = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    expected = sorted(str(tuple(r[k] for k in order)) for r in theirs.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in ours.collect()) == expected


def test_chat_ties_are_ordered_alike(spark, tmp_path):
    rows = [(1, 0, "user", t) for t in ("b", "a", None, "b", "é c")] + [(1, 0, None, "x"), (2, None, "assistant", "y"), (2, None, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.sql(queries.OP4_SQL)
    ours = queries.op4_chat_format(spark, str(tmp_path)).select(*theirs.columns)
    assert sorted(map(str, map(tuple, ours.collect()))) == sorted(map(str, theirs.fetchall()))


def test_chat_ids_are_the_tokenizers(monkeypatch):
    import public_tokenizers

    codec = chat_format.Codec(queries.tokenizer_path(queries.TOKENS), public_tokenizers.PATTERN)
    plain = codec.encoding.encode_ordinary
    rng = random.Random(4)
    for text in ("x" * 100_042, "word " * 20_009, "".join(rng.choice("abcdefg") for _ in range(10**6)), "!" * 10**6, "a\n" * 500_000):
        assert codec.encode(text) == plain(text)
    blanks = codec.encode("a" + " " * 10**6 + "b")
    assert codec.encoding.decode(blanks) == "a" + " " * 10**6 + "b"
    monkeypatch.setattr(chat_format, "MAX_BLANKS", 3)
    codec = chat_format.Codec(queries.tokenizer_path(queries.TOKENS), public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "\xa0", "　", "a", "é", "!", "1", "'s"]) for _ in range(rng.randint(0, 30)))
        assert codec.encode(text) == plain(text)


def test_pieces_do_not_depend_on_what_is_cached(monkeypatch):
    model = queries.tokenizer_path(queries.PIECES)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeéß日\n▁\0") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    expected = piece_bpe.PieceTable(model).model.encode(texts, add_eos=True)
    for words, bits, probes, pairs, long in ((50, 6, 1, 2, 5), (10**6, 12, 8, 8, 200), (0, 21, 2, 20, 1)):
        for name, value in (("WORDS", words), ("WORD_BITS", bits), ("PROBES", probes), ("PAIR_BITS", pairs), ("LONG", long)):
            monkeypatch.setattr(piece_bpe, name, value)
        table = piece_bpe.PieceTable(model)
        for _ in range(2):
            assert [ids for k in range(0, 300, 40) for ids, _ in table.encode_all(texts[k : k + 40])] == expected


def test_piece_table_is_kept_by_process():
    model = queries.tokenizer_path(queries.PIECES)
    assert piece_bpe.piece_table(model) is piece_bpe.piece_table(model)


def test_urls_in_several_passes(spark, monkeypatch):
    rng = random.Random(1)
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((rng.choice(["com", "a.com", "b.a.com", "net"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4)))) for _ in range(60))}.values())
    urls = [f"http://{rng.choice(['com', 'a.com', 'x.a.com', 'b.a.com', 'net', 'org'])}/{''.join(rng.choice('ab/') for _ in range(rng.randint(0, 6)))}" for _ in range(300)]
    expected = {}
    for n, url in enumerate(urls):
        host, path = url_filter.split_url(url)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: (r[1].count("."), len(r[2])), default=None)
        expected[n] = (best[1] + best[2], best[0]) if best else (None, "allow")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (1_000_000, 7):
        monkeypatch.setattr(url_filter, "MAX_RULES", most)
        assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()} == expected


def test_many_rules_of_one_host_take_no_longer():
    trie = url_filter.build_trie([("block", "com", f"/p{k}x") for k in range(200_000)])
    began = time.time()
    assert all(url_filter.longest_match(trie, "a.com", f"/p{k}x/y")[0] == f"com/p{k}x" for k in range(0, 200_000, 10))
    assert time.time() - began < 5


def test_archives_stream_by_in_any_parts():
    blocks = [b"", b"\r\n", b"a\r\n\r\n", b"\r\n\r\n\r\nWARC/1.1\r\n", b"x" * 5000, b"\r\n\r\n"]
    data = b"".join(b"WARC/1.1\r\nN: %d\r\nContent-Length: %d\r\n\r\n" % (k, len(b)) + b + b"\r\n\r\n" for k, b in enumerate(blocks))
    for size in (1, 7, 100, len(data)):
        stream = warc.RecordStream()
        found = [r for at in range(0, len(data), size) for r in stream.feed(data[at : at + size])]
        stream.close()
        assert [b for _, b in found] == blocks and [h["n"] for h, _ in found] == [str(k) for k in range(len(blocks))]
    stream = warc.RecordStream()
    list(stream.feed(data[:-9]))
    with pytest.raises(ValueError, match="ends within a record"):
        stream.close()
