"""Boundaries of the column functions and the predicate language."""

import math
import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import curves, ev, stats
from tidemark.operators import asof
from tidemark.operators.predicates import check_predicate, compile_predicate


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs)) if xs else F.array().cast("array<double>")


def test_curve_kernels(spark):
    assert value(spark, curves.deltas(arr(1, 3, 2))) == [2.0, -1.0]
    assert value(spark, curves.deltas(arr(1))) == [] == value(spark, curves.extrema(arr()))
    assert value(spark, curves.extrema(arr(1, 2, 2, 1))) == []  # a plateau is no extremum
    assert value(spark, curves.area_ratio(arr(1, 2, 3))) == 0.5
    assert value(spark, curves.curliness(arr(1, 2, 1))) == 2.0
    assert value(spark, curves.drawdown(arr(1, 5, 2, 4))) == 3.0
    assert value(spark, curves.slope(arr(0, 1, 2))) == pytest.approx(2.0)


def test_wilson_without_observations(spark):
    zero = F.lit(0)
    assert value(spark, stats.wilson_lower(zero, zero)) == 0.0
    assert tuple(value(spark, stats.wilson_bounds(zero, zero, 1.96, (0, 1)))) == (0.0, 1.0)
    assert tuple(value(spark, stats.wilson_bounds(zero, zero, 1.96, (None, None)))) == (None, None)


def test_values_of_a_bet(spark):
    none = F.lit(None).cast("boolean")
    assert value(spark, ev.realised(none, F.lit(0.5))) is None
    assert value(spark, ev.realised(F.lit(True), F.lit(1.5))) == pytest.approx(0.98 / 0.99 - 1)
    assert value(spark, ev.realised_or_fallback(F.lit(True), F.lit(None).cast("double"))) == pytest.approx(0.98 / 0.51 - 1)


def test_exact_binomial(spark):
    assert value(spark, stats.binomial_p(F.lit(5), F.lit(10), F.lit(0.5))) == pytest.approx(1.0)
    assert value(spark, stats.binomial_p(F.lit(10), F.lit(10), F.lit(0.5))) == pytest.approx(2 / 1024)


@pytest.mark.parametrize("n, k, p0", [(10, 3, 0.5), (2500, 1180, 0.5), (2500, 900, 0.3), (400_000, 199_000, 0.5), (7, 7, 0.2)])
def test_binomial_is_exact_at_every_size(n, k, p0):
    """Against sums of whole-number binomials (small n), and the normal law with continuity (large n)."""
    two, low = stats.exact_two_sided(k, n, p0), stats.exact_lower(k, n, p0)
    if n <= 2500:
        q = Fraction(p0).limit_denominator(10)
        mass = [math.comb(n, i) * q.numerator**i * (q.denominator - q.numerator) ** (n - i) for i in range(n + 1)]
        whole = q.denominator**n
        assert low == pytest.approx(float(Fraction(sum(mass[: k + 1]), whole)), rel=1e-9)
        assert two == pytest.approx(float(Fraction(sum(m for m in mass if m * 10**9 <= mass[k] * (10**9 + 1)), whole)), rel=1e-9)
    else:
        z = (k + 0.5 - n * p0) / math.sqrt(n * p0 * (1 - p0))
        assert low == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), rel=2e-3)
    assert stats.exact_two_sided(None, n, p0) == 1.0 == stats.exact_lower(k, 0, p0) and stats.exact_two_sided(0, 100_000, 0.5) == 0.0


def test_normal_law(spark):
    xs = [-40.0, -8.0, -7.0, -2.5, -1e-9, 0.0, 0.3, 1.96, 6.0, 7.2, 12.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-7, abs=1e-300)
    con = duckdb.connect()
    for x in xs:
        assert con.execute(f"SELECT {stats.normal_cdf_sql(f'({x})')}").fetchone()[0] == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-7, abs=1e-300)


def test_predicate_catalogue_and_spacing(spark):
    from tidemark.plans.prediction import PREDICATES, spacing

    assert len(PREDICATES) == 294
    at = lambda *xs: spacing(F.array(*map(F.lit, xs)))
    cases = {"insufficient": (1, 4), "shrinking": (0, 5, 8, 9), "expanding": (0, 1, 3, 7), "mixed": (0, 2, 4)}
    assert {name: value(spark, at(*xs)) for name, xs in cases.items()} == {k: k for k in cases}


def test_as_of_carries_over_empty_buckets(spark):
    left = spark.createDataFrame([(1, 95), (1, 5), (2, 50), (None, 50)], "k int, t int")
    right = spark.createDataFrame([(1, 7, 1.0), (1, 12, None), (1, 31, 3.0), (None, 49, 9.0)], "k int, t int, v double")
    got = {(r.k, r.t): r.x for r in asof.as_of(left, right, "k", "t", "v", "x", width=10).collect()}
    assert got == {(1, 95): 3.0, (1, 5): None, (2, 50): None, (None, 50): 9.0}


def test_ranks_come_from_counts(spark):
    from tidemark.plans.discovery import ranked

    ps = [0.0, 0.5, 0.5, 1.0, 0.25, 0.25, 0.25, 1.0]
    rows = spark.createDataFrame(list(enumerate(ps)), "id int, p double")
    for cells in (1, 2, 4096):
        got = {r.id: (r["rank"], r.m) for r in ranked(rows, "p", "rank", cells).collect()}
        assert got == {i: (1 + sum(q < p for q in ps), 8) for i, p in enumerate(ps)}


def test_every_module_can_be_imported_alone():
    import subprocess
    import sys

    code = "import importlib, sys; [importlib.import_module('tidemark.plans.' + m) for m in sys.argv[1:]]"
    for m in ("market", "windows", "joins", "accounting", "discovery", "detection", "lifecycle", "audits", "prediction", "scenes", "records"):
        assert subprocess.run([sys.executable, "-c", code, m], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0, m


def test_redundancy_against_plain_numbers(spark):
    from tidemark.plans import hypotheses

    names = ["ret", "rng", "body", "close_pos", "upper", "lower", "v"]
    x = np.array([[float(r[c]) for c in names] for r in hypotheses.features(spark, "/root/testdata/sf0.001").dropna(subset=names).collect()])
    got = hypotheses.feature_redundancy(spark, "/root/testdata/sf0.001").first()
    corr = np.corrcoef(x, rowvar=False)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    p = s / s.sum()
    assert got.n == len(x) and got.mean_abs_corr == pytest.approx(np.abs(corr[~np.eye(7, dtype=bool)]).mean(), abs=1e-3)
    assert got.effective_rank == pytest.approx(float(np.exp(-(p * np.log(p)).sum())), abs=1e-3)


def test_clusters_are_those_of_the_nearest_centre(spark):
    from tidemark.plans import shapes
    from tidemark.plans.lifecycle import HALF

    rows = shapes.shape_descriptors(spark, "/root/testdata/sf0.01").withColumn("outcome", F.lit("UP"))
    got = shapes.clusters(rows, k=4).select("series", "start", "cluster", *shapes.CLUSTER_ON).collect()
    x = np.array([[float(r[c]) for c in shapes.CLUSTER_ON] for r in got])
    early, of = np.array([r.start < HALF for r in got]), np.array([r.cluster for r in got])
    z = (x - x[early].mean(axis=0)) / x[early].std(axis=0, ddof=1)
    centres = np.array([z[early & (of == c)].mean(axis=0) for c in range(4)])
    near = ((z[:, None] - centres) ** 2).sum(axis=2)
    assert (near[np.arange(len(of)), of] <= near.min(axis=1) + 0.05 * near.mean()).mean() > 0.97
    card = shapes.cluster_track(spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r.right <= r.n_holdout for r in card) and sum(r.n_train for r in card) > 100


def test_bootstrap_against_plain_draws(spark):
    from tidemark.functions import ev
    from tidemark.plans import accounting, discovery

    sf = "/root/testdata/sf0.01"
    rows = accounting.bets(spark, sf).select("version", F.floor(F.col("t") / 86_400_000).alias("day"), ev.realised(F.col("win"), F.col("entry")).alias("pnl")).collect()
    for r in discovery.bootstrap_intervals(spark, sf).collect():
        days = {}
        for x in rows:
            if x.version == r.version:
                days.setdefault(x.day, []).append(x.pnl)
        groups = [days[k] for k in sorted(days)]
        at = np.random.default_rng(7).integers(0, len(groups), (2000, len(groups)))
        means = [sum(sum(groups[j]) for j in draw) / sum(len(groups[j]) for j in draw) for draw in at]
        assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9)


@pytest.mark.parametrize("bad", [{}, {"op": "X"}, {"op": "NOT", "args": []}, {"op": "has_subseq", "seq": ["up"]}, {"op": "peak_count", "cmp": ">", "k": 11}])
def test_predicates_are_checked(bad):
    with pytest.raises(ValueError):
        check_predicate(bad)


def test_not_of_a_missing_channel_is_true(spark):
    p = {"op": "NOT", "args": [{"op": "count_symbol", "symbol": "flat", "cmp": ">=", "k": 1}]}
    none = F.lit(None).cast("array<string>")
    assert value(spark, compile_predicate(p, none, F.lit(None).cast("array<double>"))) is True


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 7.0), (1, 11, 8.0)], "k int, t int, v double")
    got = {(r.k, r.t): r.x for r in asof.as_of(left, right, "k", "t", "v", "x").collect()}
    assert got == {(1, 5): 7.0, (1, 10): 7.0, (2, 1): None}


def test_append_new_is_idempotent(spark, tmp_path):
    from tidemark.streaming.windows import append_new

    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    write = append_new(str(tmp_path / "sink"), ["a"])
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_cool_down_keeps_what_a_plain_loop_keeps(spark):
    from tidemark.plans.audits import COOL_DOWN_MS, cooled

    times = [0, 1, COOL_DOWN_MS - 1, COOL_DOWN_MS, COOL_DOWN_MS + 5, 2 * COOL_DOWN_MS, 9 * COOL_DOWN_MS, 9 * COOL_DOWN_MS]
    df = spark.createDataFrame([(times,), ([],)], "ts array<long>").select(cooled("ts").alias("x"))
    want = []
    for t in times:
        if not want or t - want[-1] >= COOL_DOWN_MS:
            want.append(t)
    assert [r.x for r in df.collect()] == [want, []]


def test_trigger_is_given_once_over_many_batches(spark, tmp_path):
    from tidemark.streaming import windows

    events = spark.createDataFrame([(i, 40 * (i % 3)) for i in range(60)], "event_id long, user_id long").selectExpr("event_id", "user_id", "timestamp_seconds(1704067200 + event_id * 240) AS ts", "50D AS value")
    for k in range(4):  # ascending in time, so that no row is late
        events.filter(f"event_id DIV 15 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.trigger_at(windows.read_stream(spark, str(tmp_path / "in")), k=4)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.series, r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(s, (1704067200 + 3600 * h) * 1000) for s in range(3) for h in range(4)]
