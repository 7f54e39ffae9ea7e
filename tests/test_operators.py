"""The bootstrap, neighbours, snapshots, shuffles and trailing runs against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, neighbours
from tidemark.operators.snapshots import FREEZE_MS, Snapshots, at_their_time
from tidemark.plans import alerts, robustness


def plain_mix(x):
    x = (x ^ x >> 16) * 0x7FEB352D % 2**32
    x = (x ^ x >> 15) * 0x846CA68B % 2**32
    return x ^ x >> 16


def plain_weight(ids, r):
    seed = 0
    for x in ids:
        seed = plain_mix((seed + x) % 2**32)
    u = plain_mix((seed + r * 0x9E3779B9) % 2**32) / 2**32
    k, p = 0, math.exp(-1)
    total = p
    while u >= total and k < 12:
        k += 1
        p /= k
        total += p
    return k


@pytest.mark.parametrize("partitions", [1, 5])
def test_bootstrap_against_plain_weights(spark, partitions, monkeypatch):
    monkeypatch.setattr(bootstrap, "UNITS", 7)
    monkeypatch.setattr(bootstrap, "HELD", 3)
    rng = np.random.default_rng(2)
    rows = [(int(g), int(u), int(u % 5), float(rng.normal()), int(rng.integers(1, 4))) for u in range(60) for g in rng.choice(8, 3, replace=False)]
    df = spark.createDataFrame(rows, "grp long, a long, b long, v double, n long").repartition(partitions)
    got = {r.grp: (r.lo, r.hi) for r in bootstrap.ratio_intervals(df, "grp", ["a", "b"], "v", "n", 300).collect()}
    for g in range(8):
        mine = [r for r in rows if r[0] == g]
        means = []
        for k in range(1, 301):
            w = [plain_weight((a, b), k) for _, a, b, _, _ in mine]
            size = sum(x * n for x, (*_, n) in zip(w, mine, strict=True))
            if size:
                means.append(sum(x * v for x, (_, _, _, v, _) in zip(w, mine, strict=True)) / size)
        assert got[g] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-12)


def test_bootstrap_covers_the_mean_and_takes_no_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, size=(200, 40))
    rows = [(t, t * 1000 + k, float(v), 1) for t, row in enumerate(x) for k, v in enumerate(row)]
    df = spark.createDataFrame(rows, "t long, u long, v double, n int")
    got = bootstrap.ratio_intervals(df, "t", ["u"], "v", "n", 400).collect()
    assert 0.88 <= np.mean([r.lo <= 5 <= r.hi for r in got]) <= 0.98
    assert bootstrap.ratio_intervals(df.limit(0), "t", ["u"], "v", "n", 50).collect() == []


def vectors(spark, x, more=()):
    return spark.createDataFrame([*((int(k), [float(a) for a in v]) for k, v in enumerate(x)), *more], "id long, v array<double>")


@pytest.mark.parametrize("prune", [True, False])
def test_neighbours_against_brute_force(spark, prune, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 50)
    monkeypatch.setattr(neighbours, "SALTED", 100)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, size=(150, 5)) for c in rng.normal(0, 3, size=(6, 5))])
    x[200:420] = x[200]  # a hot vector and many ties
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [0.0] * 5), (2004, [1.0]), (None, [1.0] * 5), (7, [99.0] * 5)]
    df = vectors(spark, x, bad)
    got = {}
    for r in neighbours.most_similar(df.filter("id % 9 = 0 OR id = 2004"), df, 4, 5, prune).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    for q in range(0, len(x), 9):
        order = [k for k in np.lexsort((np.arange(len(x)), -sim[q])) if k != q][:4]
        assert [(k, o) for k, o, _ in sorted(got[q])] == [(k + 1, int(o)) for k, o in enumerate(order)]
    assert set(got) == set(range(0, len(x), 9))


def test_neighbours_prune_and_few_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.02, size=(100, 4)) for c in 5 * np.eye(4)])
    df = vectors(spark, x)
    needed = []

    def read(df, label, keep=neighbours.written):
        out = keep(df, label)
        if label == "questions":
            needed.extend(len(r.cells) for r in out.collect())
        return out

    neighbours.written, before = read, neighbours.written
    try:
        neighbours.most_similar(df.filter("id % 20 = 0"), df, 3, 4).collect()
    finally:
        neighbours.written = before
    assert needed and np.mean(needed) <= 10  # of 20 cells
    few = vectors(spark, [[1.0, 0.0], [1.0, 1.0]])
    assert [(r.id, r.other) for r in neighbours.most_similar(few, few, 5, 2).orderBy("id").collect()] == [(0, 1), (1, 0)]
    assert neighbours.most_similar(few, few.limit(0), 5, 2).collect() == [] == neighbours.most_similar(few.limit(0), few, 5, 2).collect()
    votes = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5), (2, 7)], "id long, other long")
    labels = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b")], "other long, label string")
    assert {r.id: (r.voted, r.votes) for r in neighbours.voted(votes, labels).collect()} == {1: ("a", 2), 2: (None, 1)}


def test_snapshots_are_reused_recomputed_and_read_by_version(spark, tmp_path):
    day = 86_400_000
    assert FREEZE_MS == 30 * day
    channels = ("crowd", "quote", "volume")

    def changes(series, kinds, n, by=1.0):
        return [(s, c, by * k) for s, c, k in itertools.product(series, kinds, range(n))]

    def frame(rows):
        return spark.createDataFrame(rows, "series long, channel string, dl double")

    s = Snapshots(f"file://{tmp_path}/table")
    first = s.ensure(frame(changes([1], channels, 20) + changes([2], channels[:2], 20) + changes([3], channels, 9)), 0)
    assert {(r.series, r.channel) for r in first.collect()} == {(1, c) for c in channels} | {(2, c) for c in channels[:2]}
    # 1 is young and complete, 2 lacks a channel, 3 had too few changes
    rows = changes([1, 2], channels, 20, 2.0) + changes([3], channels, 10)
    for _ in range(2):  # a repeated run gives the same table
        second = {(r.series, r.version) for r in s.ensure(frame(rows), 29 * day).collect()}
        assert second == {(1, "v0"), (2, f"v{29 * day}"), (3, f"v{29 * day}")}
    third = {(r.series, r.version) for r in s.ensure(frame(changes([2], channels, 20)), 30 * day).collect()}
    assert third == second  # 1 is due, but has no changes any more: the old one stays
    fourth = {(r.series, r.version, round(r.edges[3], 6)) for r in s.ensure(frame(changes([1, 2], channels, 21)), 31 * day).filter("channel = 'quote'").collect()}
    assert fourth == {(1, f"v{31 * day}", 16.0), (2, f"v{29 * day}", 30.4), (3, f"v{29 * day}", 7.2)}
    assert s.table(spark).count() == 3 + 2 + 6 + 3
    times = spark.createDataFrame([(1, -1), (1, 0), (1, 31 * day - 1), (1, 31 * day), (2, 29 * day), (9, 5)], "series long, t long")
    got = sorted((r.series, r.t, r.version) for r in at_their_time(times, s.valid(spark, "quote"), "series", F.col("t")).collect())
    assert got == [(1, -1, None), (1, 0, "v0"), (1, 31 * day - 1, "v0"), (1, 31 * day, f"v{31 * day}"), (2, 29 * day, f"v{29 * day}"), (9, 5, None)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_shuffles_stay_inside_blocks(spark, partitions):
    rng = np.random.default_rng(6)
    cycles = [(s, b, 100 * b + h, bool(rng.random() < 0.4), [bool(x) for x in rng.random(3) < 0.3]) for s in range(2) for b in range(3) for h in range(int(rng.integers(2, 15)))]
    df = spark.createDataFrame(cycles, "series long, block long, hour long, up boolean, flags array<boolean>").repartition(partitions)
    got = {(r.grp, r.replicate): r.s0 for r in robustness.shuffled_counts(df, 3, 40).collect()}
    for r in range(1, 41):
        want = [0, 0, 0]
        for _, group in itertools.groupby(sorted(cycles), key=lambda c: c[:2]):
            group = list(group)
            drawn = sorted(group, key=lambda c: (plain_mix((plain_mix((plain_mix(c[0]) + c[2]) % 2**32) + r * 0x9E3779B9) % 2**32), c[2]))
            for c, source in zip(drawn, group, strict=True):
                for k in range(3):
                    want[k] += c[4][k] and source[3]
        assert [got[k, r] for k in range(3)] == want


def test_trailing_failures_in_any_buckets(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{k % 4}", int(t), int(k), bool(rng.random() < 0.5)) for k, t in enumerate(rng.integers(0, 50, 300))] + [("never", 1, 1000, False), ("never", 40, 1001, False), ("good", 3, 1002, True)]
    df = spark.createDataFrame(rows, "phase string, t long, event_id long, ok boolean")
    want = {}
    for p in {r[0] for r in rows}:
        n = 0
        for *_, ok in sorted((r[1], r[2], r[3]) for r in rows if r[0] == p):
            n = 0 if ok else n + 1
        want[p] = n
    for width in (1, 7, 100):
        assert {r.phase: r.failures for r in alerts.trailing(df, "phase", F.floor(F.col("t") / width)).collect()} == want
