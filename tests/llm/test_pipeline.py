"""Every stage of the corpus pipeline against a plain version, on documents with odd rows; then the whole run."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_search import plain_groups
from tidemark.llm import packing, quality, secrets, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_copy int, keep string"
KEY = "b7db7aa4a5fcc783055fd5b7db7aa4a5fcc78305"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, k, "own") for k, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect())]
    good = next(r for r in rows if r[1] and len(r[1]) > 2000)
    top = max(r[0] for r in rows)
    rows += [
        (top + 1, None, None, None, None, 1, "own"), (top + 2, "", "en", "a", 0, 2, "own"), (None, good[1] + " and so on.", "en", None, 1, 3, "own"), (None, good[1] + " and so on.", "en", None, 1, 3, "own"),
        (top + 3, good[1], "en", "rare", 1, 4, "own"), (top + 4, good[1].upper().lower() + " The end.", "en", "rare", 1, 5, "own"), (top + 5, f'{good[1]} It has another end, where the password = "{KEY}" stands.', "en", "rare", 1, 6, "own"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_copies(rows):
    """How often each row is repeated: the Poisson law of its source's rate, inverted at the hash of its doc_id."""
    of, out = Counter(r[3] for r in rows), []
    for r in rows:
        rate = len(rows) / len(of) / of[r[3]]
        u = int(hashlib.md5(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-rate)
        n = 0
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out += [r] * n
    return sorted(out, key=repr)


def test_each_stage_against_a_plain_version(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram jaccard join", "secret scans", "mixing sources", "packing"]
    rows = plain(docs)

    def step(name, before):
        out = stages[name](spark, spark.createDataFrame(before, SCHEMA), SF)
        assert name == "packing" or out.columns == docs.columns
        return plain(out)

    kept = step("quality classifier", rows)
    words = quality.Words(weights=quality.train(docs).weights)
    assert kept == [r for r in rows if r[1] and r[1].split() and words.score(r[1])[1] >= 0.5] and 0 < len(kept) < len(rows)

    one = step("n-gram jaccard join", kept)
    groups = plain_groups([(k, r[1]) for k, r in enumerate(sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))) if r[0] is not None], 5, 80)
    by_id = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])
    assert one == sorted([r for k, r in enumerate(by_id) if groups[k][1] == k] + [r for r in kept if r[0] is None], key=repr)
    assert 0 < len(one) < len(kept)

    clean = step("secret scans", one)
    scanner = secrets.train(secrets.rule_findings(spark), secrets.learn_words(spark.createDataFrame(one, SCHEMA)))
    numbered = [(k, *r) for k, r in enumerate(one)]
    found = secrets.scan(spark.createDataFrame(numbered, "row long, " + SCHEMA), scanner, "row").filter("is_secret").collect()
    want = {k: [*r] for k, *r in numbered}
    for hit in found:  # each value is gone from where it stood; the other words stay
        assert hit.value in want[hit["row"]][1]
        want[hit["row"]][1] = want[hit["row"]][1].replace(hit.value, "[SECRET]", 1)
    for r in want.values():
        r[4] = len(r[1]) if r[1] and "[SECRET]" in r[1] else r[4]
    assert clean == sorted(map(tuple, want.values()), key=repr) and not any(KEY in r[1] for r in clean)

    mixed = step("mixing sources", clean)
    assert mixed == plain_copies(clean)

    pieces = stages["packing"](spark, spark.createDataFrame(mixed, SCHEMA), SF).collect()
    check_pieces(pieces, mixed)


def check_pieces(pieces, rows):
    """Each row's ids lie once in the pieces, sequences are full or of a power of two."""
    library = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = {}
    for r in {(r[0], r[1]) for r in rows}:
        ids.setdefault(r[0], []).append(np.asarray([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    total = Counter()
    for r in rows:
        total[r[0]] += len(next(x for x in ids[r[0]] if True)) if len(ids[r[0]]) == 1 else 0
    sums, by_sequence = Counter(), {}
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        sums[p.doc_id] += p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sums[k] == n for k, n in total.items() if n)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0


def test_the_whole_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.columns == [f.split()[0] for f in packing.PIECES.split(", ")]
    stage, rows = dict(corpus_pipeline.STAGES), docs
    for name in list(stage)[:-1]:
        rows = spark.createDataFrame(stage[name](spark, rows, SF).collect(), SCHEMA)
    check_pieces(pieces.collect(), plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, 1, "x"), (None, "", None, None, 0, 1, "x"), (None, "", None, None, 0, 1, "x")]])
def test_runs_without_anything_to_keep(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_go_through_every_stage(spark, docs):
    """Two near copies of 200,000 words of a good text: one stays, whole, and every id of it is packed."""
    good = [r for r in docs.collect() if r.text and 60 < len(r.text.split()) < 400 and r.text.rstrip().endswith(".")][:40]
    words = " ".join(r.text for r in good).split()
    long = " ".join(words[(k * 7919) % len(words)] for k in range(200_000))
    rows = [(900_001, long, "en", "long", len(long)), (900_002, long + " and one more sentence.", "en", "long", len(long) + 23)]
    stage, now = dict(corpus_pipeline.STAGES), docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {}
    for name in list(stage)[:-2]:
        now = spark.createDataFrame(stage[name](spark, now, SF).collect(), now.schema)
        kept[name] = sorted(r.doc_id for r in now.filter("doc_id > 900000").collect())
    assert kept["quality classifier"] in ([900_001, 900_002], []) and kept["n-gram jaccard join"] == kept["quality classifier"][:1] == kept["secret scans"]
    one = spark.createDataFrame(rows[:1], now.schema)
    library = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    pieces = stage["packing"](spark, one, SF).collect()
    assert sum(p.length for p in pieces) == len(library.encode(long, add_special_tokens=False).ids) + 1 and len({p.sequence_id for p in pieces}) > 40
