"""License scans, whitening and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, importance, licences, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {a: a + 32 for a in range(65, 91)}
SCHEMA = "doc_id long, text string, weight int, score int, label int, n int"
SIGNS = "cc by CC-BY general public license all rights reserved é ½ ,, x GENERAL\tPublic\nLICENSE longer-than-a-part-of-a-text".split(" ")


def texts(n, seed=3):
    rng = random.Random(seed)
    return [None, "", " ,; ", *(rng.choice([" ", "-", "\n", "  "]).join(rng.choices(SIGNS, k=rng.randint(1, 60))) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 7, 7, 7, 7) for k, t in rows], SCHEMA)


def words_of(text):
    return WORD.findall((text or "").translate(SMALL))


# License scans


@pytest.mark.parametrize("part", [16, 1 << 20])
def test_base_places(part, monkeypatch):
    monkeypatch.setattr(common, "BYTES_AT_ONCE", part)
    scanner = licences.Scanner()
    for t in texts(400):
        w = words_of(t)
        places = [(k, label) for p, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at, names = [k for k, _ in places], {label for _, label in places}
        got = scanner.scan(t.encode() if t is not None else None)
        assert got[:5] == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(names)))
        assert names <= set(got[5].split(",")) | {""} and 0 <= got[6] <= 1


@pytest.mark.parametrize(
    ("line", "form", "labels", "score"),
    [
        ("MIT", "mit", {"mit"}, 0.1),
        ("MIT OR GPL-3.0-only AND Apache-2.0", "mit or gpl-3.0-only and apache-2.0", {"mit", "gpl", "apache"}, 0.1),
        ("(MIT OR GPL-3.0+) AND Apache-2.0", "(mit or gpl-3.0+) and apache-2.0", {"mit", "gpl", "apache"}, 0.2),
        ("MIT AND GPL-2.0 WITH Classpath-exception-2.0", "mit and gpl-2.0 with classpath-exception-2.0", {"mit", "gpl"}, 0.4),
        ("MIT/Apache-2.0 see the file", "mit or apache-2.0", {"mit", "apache"}, 0.1),
        ("((((MIT))))", "mit", {"mit"}, 0.1),
        ("MIT OR (GPL-3.0 AND", "mit", {"mit"}, 0.1),
        ("MIT. More of it below", "mit", {"mit"}, 0.1),
        ("MIT with", "mit", {"mit"}, 0.1),
        ("CC-BY-SA-4.0 or LicenseRef-own", "cc-by-sa-4.0 or licenseref-own", {"cc-by-sa", "licenseref"}, 0.7),
    ],
)
def test_expressions(line, form, labels, score):
    got = licences.evaluate(line)
    assert (got[0], got[1]) == (form, labels) and abs(got[2] - score) < 1e-12
    assert licences.evaluate(got[0])[0] == form


def test_what_is_no_expression():
    for line in ("", "see file", "OR MIT", ")", "(((", "with MIT", "unknown-1.0", "and or"):
        assert licences.evaluate(line) is None


def test_expressions_against_a_recursive_reader():
    """Random expressions, evaluated by the tree they were made from."""
    rng = random.Random(8)
    names = ["MIT", "GPL-3.0", "Apache-2.0", "MPL-2.0", "AGPL-3.0-only", "ISC"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            value = licences.RESTRICTS[licences.label_of(name)]
            return (f"{name} WITH an-exception", value / 2, 3) if rng.random() < 0.2 else (name, value, 4)
        op, rank = rng.choice([("OR", 1), ("AND", 2)])
        a, b = tree(depth - 1), tree(depth - 1)
        show = [f"({s})" if r < rank or (r == rank and k) else s for k, (s, _, r) in enumerate((a, b))]
        return f"{show[0]} {op} {show[1]}", (min if op == "OR" else max)(a[1], b[1]), rank

    for _ in range(300):
        text, value, _ = tree(4)
        assert abs(licences.evaluate(text)[2] - value) < 1e-12, text


def test_deep_brackets_and_very_long_lines():
    deep = "(" * 50_000 + "MIT" + ")" * 50_000
    assert licences.evaluate(deep)[0] == "mit"
    assert licences.evaluate(" OR ".join(["MIT"] * 20_000))[2] == 0.1
    scan = licences.Scanner().scan(("a" * 3_000_000 + " cc by " + "word " * 600_000 + "cc by\nLicense: GPL-3.0").encode())
    assert scan[:4] == (600_009, 2, 1, 600_003) and scan[5] == "cc-by,gpl"


def test_tags_that_say_nothing():
    scanner = licences.Scanner()
    for t in ("sublicense: MIT", "The licence: who knows", "license MIT", "non-license: MIT"):
        assert scanner.scan(t.encode())[5:] == ("", 0.0, "")
    assert scanner.scan(b"x\nLICENCE:  'MIT' \nSPDX-License-Identifier: MIT AND BSD-3-Clause")[5:] == ("bsd,mit", 0.15, "mit; mit and bsd-3-clause")


def test_license_rows(spark):
    rows = [(k, t) for k, t in enumerate(texts(30))] + [(3, "cc by"), (3, "cc by"), (None, "cc by")]
    got = licences.licences(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.base_labels == "cc-by" and r.n_words == 2 for r in got) >= 3
    assert licences.licences(frame(spark, []).limit(0)).collect() == []


# Whitening


def plain_whitening(vectors, most=32):
    """By rational numbers up to the covariance."""
    dim = max(map(len, vectors))
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)) for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in away)) / n**3 for j in range(dim)] for i in range(dim)])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:most]
    return [sum(c * c for c in r) for r in away], (np.array(away, float) / n) @ v[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


def check_whitening(got, vectors, most=32):
    deviation, w, share = plain_whitening(vectors, most)
    k = w.shape[1]
    assert len(got) == len(vectors) * k
    mine = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(w.shape)
    sign = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w * sign).max() < 1e-6
    for r in got:
        assert int(r.deviation_exact) == deviation[r.vec_id] and (r.deviation == deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else r.deviation is None)
        assert r.n == len(vectors) and abs(r.explained / share[r.component - 1] - 1) < 1e-8 and r.identity_error < 1e-8


VECTORS = "vec_id long, embedding array<double>, component int, n int, v int, id int"


def vector_frame(spark, vectors, more=()):
    return spark.createDataFrame([*((k, v, 7, 7, 7, 7) for k, v in enumerate(vectors)), *more], VECTORS)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e14])
def test_whitening_against_rationals(spark, size):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * size + 3 * size).tolist()
    odd = [(900, None, 7, 7, 7, 7), (901, [1.0, None], 7, 7, 7, 7), (902, [float("nan")] * 40, 7, 7, 7, 7), (903, [float("-inf")] * 40, 7, 7, 7, 7)]
    check_whitening(whitening.whitened(vector_frame(spark, vectors, odd).repartition(5)).collect(), vectors)


def test_small_directions_keep_their_digits(spark):
    """Variances from 1 to 1e20: the error of the identity stays small."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    vectors = ((rng.normal(size=(500, 6)) * 10.0 ** np.array([11, 9, 7, 5, 3, 1])) @ turn).tolist()
    got = whitening.whitened(vector_frame(spark, vectors)).collect()
    assert max(r.component for r in got) == 6 and got[0].identity_error < 1e-4


def test_unequal_lengths_repeats_and_no_variance(spark):
    vectors = [[1.0, 2.0], [3.0], [], [0.5, 0.25, 4.0], [1.0, 2.0], [-1.0, 1.0, 1.0]]
    check_whitening(whitening.whitened(vector_frame(spark, vectors)).collect(), vectors)
    for same in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]] * 2):
        got = whitening.whitened(vector_frame(spark, same))
        assert got.collect() == [] and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = [[float(k), 5.0, float(k % 3)] for k in range(9)]  # one direction of three has no variance
    assert {r.component for r in whitening.whitened(vector_frame(spark, flat)).collect()} == {1, 2}
    huge = whitening.whitened(vector_frame(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 7.0]])).collect()
    assert all((r.deviation is None) == (r.vec_id < 2) and int(r.deviation_exact) > 0 for r in huge)


def test_exact_sums_of_any_size():
    rng = np.random.default_rng(6)
    for top in (1, 1 << 19, 1 << 21, 1 << 45, 1 << 62):
        y = rng.integers(-top, top, size=(50, 4), endpoint=True)
        first, second = whitening.exact_sums(y)
        z = y.astype(object)
        assert (first == z.sum(axis=0)).all() and (second == z.T @ z).all()
    assert sum(d << (30 * k) for k, d in enumerate(whitening._digits(-(3**200)))) == -(3**200)


def test_whitening_as_registered(spark, tmp_path):
    import pyarrow.parquet as pq

    x = np.random.default_rng(7).normal(size=(3000, 16)).astype(np.float32)
    x[:1000] = x[0]  # a third of all rows
    pq.write_table(pa.table({"vec_id": np.arange(3000), "embedding": list(x)}), tmp_path / "embeddings.parquet")
    check_whitening(whitening.op12_whitening(spark, str(tmp_path)).collect(), x.tolist())


# Importance resampling


def plain_resampling(docs, target, percent=5, least=20, n=3, buckets=10_000, seed=42):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def at(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text)]

    s, t = Counter(b for _, x in docs for b in at(x)), Counter(b for x in target for b in at(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)}
    rows = []
    for k, x in docs:
        h = int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in at(x))
        score = None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([k, len(at(x)), weight, score, None, len(words_of(x)) >= least and k is not None])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("part", [16, 1 << 20])
def test_ring_emits_every_run(part, monkeypatch):
    monkeypatch.setattr(common, "BYTES_AT_ONCE", part)
    for n in (1, 2, 3, 5):
        for t in texts(60, 9):
            w = words_of(t)
            want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 997 for k in range(1, n + 1) for i in range(len(w) - k + 1))
            parts = list(importance.scan(t.encode() if t is not None else None, n, 997))
            assert Counter(b for _, at in parts for b in at.tolist()) == want and sum(m for m, _ in parts) == len(w)


@pytest.mark.parametrize("partitions", [1, 7])
def test_resampling_against_plain(spark, partitions):
    rng = random.Random(11)
    voc = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choices(voc, k=rng.randint(0, 80)))) for k in range(400)]
    docs += [(500, docs[0][1])] * 150 + [(501, None), (502, ""), (None, docs[1][1]), (503, "ÄÖ é " * 40), (504, "w1 " * 60_000)]
    target = [" ".join(rng.choices(voc[:30], k=50)) for _ in range(20)] + [None, ""]
    df, bench = frame(spark, docs).repartition(partitions), frame(spark, enumerate(target))
    got = importance.resample(df, bench, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(docs, target, percent=30)


def test_empty_sides(spark):
    docs = [(k, f"some words of text {k} " * 8) for k in range(40)]
    none = frame(spark, []).limit(0)
    assert importance.resample(none, frame(spark, docs)).collect() == []
    assert sorted(map(tuple, importance.resample(frame(spark, docs), none).collect()), key=repr) == plain_resampling(docs, [])


def test_drawn_rows_keep_their_columns(spark):
    docs = frame(spark, [(k, f"some words of text {k} " * 8) for k in range(60)] + [(None, "some words " * 30), (61, None)])
    docs = docs.withColumns({"text_hash": F.lit(1), "drawn_id": F.lit(2)})
    target = frame(spark, [(1, "text 7 some words")])
    out = importance.drawn(docs, target, percent=20)
    ranks = {r.doc_id for r in importance.resample(docs, target, percent=20).filter("rank IS NOT NULL").collect()}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ranks and len(ranks) == 12
