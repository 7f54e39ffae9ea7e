"""Token counts, token files and packing against the library, with every odd text."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_files, tokens

LONG = "abc DEF ghi. " * 20_000
ODD = [None, "", " ", "a", "a  b\n\nc's 're \t x <|endoftext|>y  \n z  ", "don't  stop now 12345", "日本語 テスト 🙂", LONG, "a", "the end.\nNext line, and more."]
SCHEMA = "doc_id long, text string, start long, length long, n_tokens long"


def docs(spark, texts=ODD):
    return spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)], SCHEMA)


def library(name):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_pieces_give_the_library_ids():
    random.seed(3)
    parts = ["a", "B", " ", "\n", "\t", "'", "s", "re", "1", "é", "!", "<|endoftext|>", "\x1c", "日", "  ", ".", ",", "Wort", "§"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 25))) for _ in range(1500)]
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    made, pieces = token_counts.prefix_table(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.byte_level_ids(tokens.tokenizer_path("byte_bpe_50k.json"))(texts)] == [byte(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.word_level_ids(tokens.tokenizer_path("word_bpe_49k.json"))(texts)] == [word(t) for t in texts]
    assert pieces.of(texts) == [len(byte(t)) for t in texts]
    for t in texts[:60]:
        assert made.prefixes(t).tolist() == [len(byte(t[:i])) for i in range(len(t) + 1)], repr(t)


def test_texts_in_fragments(monkeypatch):
    random.seed(5)
    parts = ["ab", "C", " ", " ", "\n", "\t", "'s", "12", "é", "!", "<|endoftext|>", "日", "  ", "."]
    texts = ["".join(random.choice(parts) for _ in range(200)) for _ in range(60)]
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", 12)
    assert all("".join(tokens.fragments(t)) == t for t in texts)
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    _, pieces = token_counts.prefix_table(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.byte_level_ids(tokens.tokenizer_path("byte_bpe_50k.json"))(texts)] == [byte(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.word_level_ids(tokens.tokenizer_path("word_bpe_49k.json"))(texts)] == [word(t) for t in texts]
    assert pieces.of(texts) == [len(byte(t)) for t in texts]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a", "=", "-=+", " ", "日本é", "0123456789"])
def test_long_words_in_bounded_memory(alphabet):
    random.seed(1)
    word = "x" + "".join(random.choices(alphabet, k=300_000))
    made, _ = token_counts.prefix_table(tokens.tokenizer_path("byte_bpe_50k.json"))
    stored = len(made.states)
    made.count(word[:1000])
    tracemalloc.start()
    n = made.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(library("byte_bpe_50k.json")(word)) and peak < 64_000_000 and len(made.states) <= stored + token_counts.SHORT
    short = word[:3000]
    assert made.prefixes(short)[[1, 17, 500, 2999, 3000]].tolist() == [len(library("byte_bpe_50k.json")(short[:i])) for i in (1, 17, 500, 2999, 3000)]
    whole = made.prefixes(word)  # linear in the length
    assert len(whole) == len(word) + 1 and whole[-1] == n


def test_counts_of_a_word_of_a_million_characters(spark):
    random.seed(2)
    long = ["".join(random.choices("abcdefgh01XYZ+/", k=1_000_000)), "word and more. " * 400_000]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, long)).collect()}
    assert got == {k: len(library("byte_bpe_50k.json")(t)) for k, t in enumerate(long)}


def test_token_counts(spark):
    byte = library("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark)).collect()}
    assert got == {k: (len((t or "").encode()), len(byte(t)), len(byte(t)) > 512) for k, t in enumerate(ODD)}
    assert token_counts.token_counts(docs(spark, [])).count() == 0


def test_truncation_keeps_the_longest_prefix(spark):
    byte, texts = library("byte_bpe_50k.json"), ["the quick brown fox, don't stop", None, "", "<|endoftext|> ab"]
    for r, t in zip(token_counts.truncate_to_budget(docs(spark, texts), 4).orderBy("doc_id").collect(), texts, strict=True):
        assert r.text == (t if t is None else t[: max(i for i in range(len(t) + 1) if len(byte(t[:i])) <= 4)])


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 2**32 - 1])
def test_segments_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    data = token_files.encode_segment(ids)
    assert (token_files.decode_segment(data) == ids).all()
    assert (token_files.decode_segment(data, 1, 3) == ids[1024:3072]).all()


def test_token_files(spark, tmp_path):
    byte = library("byte_bpe_50k.json")
    token_files.write_token_files(docs(spark), str(tmp_path / "t"))
    at = 0
    for r in token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect():
        ids = [*byte(ODD[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    token_files.write_token_files(docs(spark, []), str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_checksums_are_joined():
    data = np.random.default_rng(0).bytes(5000)
    for k in (0, 1, 7, 2500, 5000):
        assert token_files.joined_crc(zlib.crc32(data[:k]), zlib.crc32(data[k:]), 5000 - k) == zlib.crc32(data)


def test_documents_longer_than_a_segment_and_repeated_or_null_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 1500)
    byte, texts = library("byte_bpe_50k.json"), ["a few words", LONG[:30_000], None, "more words here " * 300, LONG[:9000], "", "the end"]
    ids = [0, 1, 2, 2, 3, None, None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    token_files.write_token_files(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).agg({"n_ids": "max"}).first()[0] <= 3000
    got, at = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect(), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None, None, 0, 1, 2, 2, 3]
    want = sorted((repr(k), crc([*byte(t), 0])) for k, t in zip(ids, texts, strict=True))
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == want


def test_tails_of_tasks_are_packed_once_more(spark):
    rows = [(k, "some words of a text, " * (1 + k % 37)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    by_seq = {}
    for r in packing.pack(df).collect():
        by_seq[r.sequence_id] = by_seq.get(r.sequence_id, 0) + r.length
    assert sum(n < 4096 for n in by_seq.values()) <= 12 and sum(by_seq.values()) > 0.9 * 4096 * len(by_seq)


def test_loss_limit_binds_on_conversations(spark):
    got = packing.packed_conversations(spark, "/root/testdata/sf0.001", limit=512, loss_limit=128).collect()
    turns = {10_000 * r.conv_id + r.turn: r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    word, by_seq, by_doc = library("word_bpe_49k.json"), {}, {}
    for r in got:
        assert r.loss_tokens == (r.length if turns[r.doc_id].role == "assistant" else 0)
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc == {k: len(word(t.text)) + 1 for k, t in turns.items()}
    loss = [sum(r.loss_tokens for r in rows) for rows in by_seq.values()]
    assert max(loss) <= 128 and sum(x >= 100 for x in loss) > 0.3 * len(loss)
    assert all((n := sum(r.length for r in rows)) == 512 or n & (n - 1) == 0 for rows in by_seq.values())


@pytest.mark.parametrize("limits", [{}, {"limit": 64, "segments": 3}, {"limit": 64, "segments": 2, "loss_limit": 10}, {"limit": 100, "loss_limit": 30, "loss_column": "n_tokens"}])
def test_packing_keeps_every_id_once_within_all_limits(spark, limits):
    word = library("word_bpe_49k.json")
    rows = packing.pack(docs(spark), **limits).collect()
    encoded = [[*word(t), 2] for t in ODD]
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = encoded[r.doc_id]
        assert r.doc_tokens == len(ids) and crc(ids[r.start : r.start + r.length]) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
    assert sorted(by_doc) == list(range(len(ODD)))
    for k, pieces in by_doc.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(word(ODD[k])) + 1
    limit = limits.get("limit", 4096)
    for pieces in by_seq.values():
        total = sum(p[1] for p in pieces)
        assert total == limit or total & (total - 1) == 0
        assert total <= limit and len(pieces) <= limits.get("segments", 256) and sum(p[2] for p in pieces) <= limits.get("loss_limit", limit)
        assert sorted(p[0] for p in pieces)[0] == 0
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words"), (None, None), (None, "z")], "doc_id long, text string")
    got = packing.pack(df).collect()
    n = lambda t: len(library("word_bpe_49k.json")(t)) + 1
    assert sum(r.length for r in got if r.doc_id == 1) == 2 * n("a b c") + n("other words") and sum(r.length for r in got if r.doc_id is None) == 1 + n("z")
