"""Registries of pre-declared hypotheses over cycles, factors from percentiles, redundancy of features."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import CYCLES_SQL

CYCLE_MS = src.HOUR_MS * src.BARS_OF_CYCLE

# Features of a cycle, each step as text that both engines read: of itself, of its past, of both.
OWN = {
    "d": "CAST(sign(c - o) AS INTEGER)", "rng": "h - l", "ret": "c / o - 1", "body": "abs(c - o) / nullif(h - l, 0)", "close_pos": "(c - l) / nullif(h - l, 0)",
    "upper": "(h - greatest(o, c)) / nullif(h - l, 0)", "lower": "(least(o, c) - l) / nullif(h - l, 0)",
}
PAST = {
    "d1": ("lag(d)", ""), "d2": ("lag(d, 2)", ""), "o1": ("lag(o)", ""), "c1": ("lag(c)", ""), "h1": ("lag(h)", ""), "l1": ("lag(l)", ""), "o15": ("lag(o, 15)", ""), "c56": ("lag(c, 56)", ""), "c16": ("lag(c, 16)", ""),
    "hi16": ("max(h)", "16 PRECEDING AND 1 PRECEDING"), "lo16": ("min(l)", "16 PRECEDING AND 1 PRECEDING"), "hi96": ("max(c)", "96 PRECEDING AND 1 PRECEDING"), "lo96": ("min(c)", "96 PRECEDING AND 1 PRECEDING"),
    "atr": ("avg(rng)", "20 PRECEDING AND 1 PRECEDING"), "v20": ("avg(v)", "20 PRECEDING AND 1 PRECEDING"), "way": ("sum(abs(c - o))", "15 PRECEDING AND CURRENT ROW"), "sd16": ("stddev_samp(ret)", "15 PRECEDING AND CURRENT ROW"),
    "sd96": ("stddev_samp(ret)", "95 PRECEDING AND CURRENT ROW"), "next_d": ("lead(d)", ""), "next_ts": ("lead(cycle_ts)", ""),
}
_HOUR, _DAY, _SLOT = "(cycle_ts / 3600000) % 24", "floor(cycle_ts / 86400000 + 3) % 7", "floor(cycle_ts / 10800000) % 8"  # day 0 is Monday
# The hypotheses by name, each a condition on the features.
HYPOTHESES = {
    "fell": "d < 0", "rose": "d > 0", "big_body_down": "d < 0 AND body >= 0.7", "big_body_up": "d > 0 AND body >= 0.7", "closed_at_low": "d < 0 AND close_pos <= 0.15", "closed_at_high": "d > 0 AND close_pos >= 0.85",
    "down_upper_shadow": "d < 0 AND upper >= 0.4", "up_lower_shadow": "d > 0 AND lower >= 0.4", "bare_up": "d > 0 AND upper + lower <= 0.15 AND body >= 0.7", "bare_down": "d < 0 AND upper + lower <= 0.15 AND body >= 0.7",
    "bull_engulf": "d > 0 AND d1 < 0 AND c > o1 AND o < c1", "bear_engulf": "d < 0 AND d1 > 0 AND c < o1 AND o > c1", "inside": "h < h1 AND l > l1", "pin_up": "upper >= 0.6 AND body <= 0.3", "pin_down": "lower >= 0.6 AND body <= 0.3",
    "broke_high": "h > hi16", "broke_low": "l < lo16", "broke_high_up": "h > hi16 AND d > 0", "broke_high_down": "h > hi16 AND d < 0", "broke_low_down": "l < lo16 AND d < 0", "broke_low_up": "l < lo16 AND d > 0",
    "broke_high_at_high": "h > hi16 AND d > 0 AND close_pos >= 0.85", "day_high": "c > hi96", "day_low": "c < lo96", "range_top": "(c - lo16) / nullif(hi16 - lo16, 0) >= 0.9", "range_bottom": "(c - lo16) / nullif(hi16 - lo16, 0) <= 0.1",
    "swept_high": "h > hi16 AND c < hi16", "swept_low": "l < lo16 AND c > lo16", "asia": f"{_HOUR} < 8", "europe": f"{_HOUR} >= 8 AND {_HOUR} < 16", "america": f"{_HOUR} >= 16", "weekend": f"{_DAY} >= 5", "first_slot": f"{_SLOT} = 0",
    "last_slot": f"{_SLOT} = 7", "monday": f"{_DAY} = 0", "friday": f"{_DAY} = 4", "two_down": "d < 0 AND d1 < 0", "two_up": "d > 0 AND d1 > 0", "three_down": "d < 0 AND d1 < 0 AND d2 < 0", "three_up": "d > 0 AND d1 > 0 AND d2 > 0",
    "down_after_up": "d < 0 AND d1 > 0", "up_after_down": "d > 0 AND d1 < 0", "up_weak_end": "d > 0 AND path LIKE '%D'", "down_strong_end": "d < 0 AND path LIKE '%U'", "wide": "rng >= 2 * atr", "narrow": "rng <= 0.5 * atr",
    "heavy": "v >= 2 * v20", "light": "v <= 0.5 * v20", "straight": "abs(c - o15) / nullif(way, 0) >= 0.8", "choppy": "abs(c - o15) / nullif(way, 0) <= 0.4", "volatile": "sd16 > sd96", "bear_week": "c < c56", "path_uud": "path = 'UUD'",
    "path_duu": "path = 'DUU'", "with_trend": "d * sign(c - c16) > 0", "against_trend": "d * sign(c - c16) < 0",
}


def _over(f: str, rows: str) -> str:
    return f"{f} OVER (PARTITION BY series ORDER BY cycle_ts{f' ROWS BETWEEN {rows}' if rows else ''})"


FEATURES_SQL = (
    CYCLES_SQL
    + f", own AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in OWN.items())} FROM cycles), past AS (SELECT *, {', '.join(f'{_over(*e)} AS {k}' for k, e in PAST.items())} FROM own), feats AS (SELECT * FROM past WHERE next_ts - cycle_ts = {CYCLE_MS} AND next_d <> 0)"
)


def features(spark, d):
    """Cycles with their features whose next cycle follows at once and has a direction."""
    own = src.cycles(src.bars(spark, d)).selectExpr("*", *(f"{e} AS {k}" for k, e in OWN.items()))
    past = own.selectExpr("*", *(f"{_over(*e)} AS {k}" for k, e in PAST.items()))
    return past.filter((F.col("next_ts") - F.col("cycle_ts") == CYCLE_MS) & (F.col("next_d") != 0))


def tested(rows, conditions: dict[str, str]):
    """hypothesis, n and n_up of every condition, counted in one pass over the rows."""
    names = list(conditions)
    counts = [x for k, name in enumerate(names) for x in (F.count_if(F.expr(conditions[name])).alias(f"n{k}"), F.count_if(F.expr(f"({conditions[name]}) AND next_d > 0")).alias(f"u{k}"))]
    cells = F.array(*(F.struct(F.lit(name).alias("hypothesis"), F.col(f"n{k}").alias("n"), F.col(f"u{k}").alias("n_up")) for k, name in enumerate(names)))
    return rows.agg(*counts).select(F.inline(cells))


#: Cases that a hypothesis needs to be tested, and the rate of false discoveries.
LEAST, FDR_Q = 5, 0.1
_Z = "(-greatest((abs(n_up - n * base) - 0.5) / sqrt(n * base * (1 - base)), 0))"


@query(
    f"WITH {FEATURES_SQL}, b AS (SELECT count(*) FILTER (next_d > 0) / count(*) AS base FROM feats), c AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS hypothesis, count(*) FILTER ({e}) AS n, count(*) FILTER (({e}) AND next_d > 0) AS n_up FROM feats" for k, e in HYPOTHESES.items())
    + f"""), t AS (SELECT c.*, base, CASE WHEN n >= {LEAST} THEN round(least(1.0, 2 * {stats.normal_cdf_sql(_Z)}), 9) END AS p FROM c, b), r AS (SELECT hypothesis, rank() OVER (ORDER BY p) AS rk, count(*) OVER () AS m, p FROM t WHERE p IS NOT NULL), k AS (SELECT max(rk) AS k FROM r WHERE p <= rk / m * {FDR_Q})
SELECT t.hypothesis, n, n_up, round(base, 9) AS base_rate, CASE WHEN n_up > n * base THEN 'UP' WHEN n_up < n * base THEN 'DOWN' END AS direction, round(t.p, 7) AS p, coalesce(rk <= (SELECT k FROM k), false) AS significant FROM t LEFT JOIN r ON t.hypothesis = r.hypothesis"""
)
def bar_hypotheses(spark, d):
    """DP22, AG30, AG31: every pre-declared hypothesis with its cases, how often the next cycle rose against the base rate, direction,
    two-sided p and step-up discovery. `volatile` and `bear_week` look back 96 and 56 cycles, for the data span a month."""
    rows = features(spark, d)
    base = rows.agg((F.count_if(F.col("next_d") > 0) / F.count("*")).alias("base"))
    t = tested(rows, HYPOTHESES).join(F.broadcast(base))  # one row
    n, k, b = F.col("n"), F.col("n_up"), F.col("base")
    t = t.withColumn("p", F.when(n >= LEAST, F.round(stats.normal_p(k, F.nullif(n, F.lit(0)), b), 9)))
    # the catalogue of 56 is ranked, whatever the data
    r = t.filter("p IS NOT NULL").select("hypothesis", F.rank().over(Window.orderBy("p")).alias("rk"), F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"), "p")
    passed = r.filter(F.col("p") <= F.col("rk") / F.col("m") * FDR_Q).agg(F.max("rk").alias("k"))
    found = r.join(F.broadcast(passed)).filter(F.col("rk") <= F.col("k")).select("hypothesis", F.lit(True).alias("significant"))
    return t.join(found, "hypothesis", "left").select("hypothesis", "n", "n_up", F.round(b, 9).alias("base_rate"), F.when(k > n * b, "UP").when(k < n * b, "DOWN").alias("direction"), F.round("p", 7).alias("p"), F.coalesce("significant", F.lit(False)).alias("significant"))


# Percentiles of the discovery part that become thresholds: feature, digits that it is read to (so that a percentile holds a bounded
# number of values), shares.
FACTORS = {"ret": (3, (0.25, 0.5, 0.75)), "close_pos": (4, (0.25, 0.5, 0.75)), "v": (0, (0.33, 0.66))}
_CUTS = [(f"{f}_{round(100 * p)}", f, digits, p) for f, (digits, ps) in FACTORS.items() for p in ps]
_SIDES = {f"{name}_{word}": f"round({f}, {digits}) {op} {name}" for name, f, digits, _ in _CUTS for word, op in (("low", "<="), ("high", ">="))}


@query(
    f"WITH {FEATURES_SQL}, cut AS (SELECT {', '.join(f'quantile_cont(round({f}, {digits}), {p}) AS {name}' for name, f, digits, p in _CUTS)} FROM feats WHERE cycle_ts < 1705276800000), late AS (SELECT * FROM feats, cut WHERE cycle_ts >= 1705276800000), b AS (SELECT count(*) FILTER (next_d > 0) / nullif(count(*), 0) AS base FROM late), c AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS hypothesis, count(*) FILTER ({e}) AS n, count(*) FILTER (({e}) AND next_d > 0) AS n_up FROM late" for k, e in _SIDES.items())
    + f") SELECT hypothesis, n, n_up, round(base, 6) AS base_rate, CASE WHEN n_up > n * base THEN 'UP' WHEN n_up < n * base THEN 'DOWN' END AS direction, CASE WHEN n >= {LEAST} THEN round(least(1.0, 2 * {stats.normal_cdf_sql(_Z)}), 7) END AS p FROM c, b"
)
def percentile_factors(spark, d):
    """DP25: factors from the discovery part's percentiles, tested on the later part: cases, rises, base rate, direction and two-sided p."""
    rows = features(spark, d)
    cut = stats.percentiles(rows.filter("cycle_ts < 1705276800000"), {f: F.round(f, digits) for f, (digits, _) in FACTORS.items()}, {name: (f, p) for name, f, _, p in _CUTS})
    late = rows.filter("cycle_ts >= 1705276800000")
    base = late.agg((F.count_if(F.col("next_d") > 0) / F.nullif(F.count("*"), F.lit(0))).alias("base"))
    t = tested(late.join(F.broadcast(cut)), _SIDES).join(F.broadcast(base))  # one row each
    n, k, b = F.col("n"), F.col("n_up"), F.col("base")
    return t.select("hypothesis", "n", "n_up", F.round(b, 6).alias("base_rate"), F.when(k > n * b, "UP").when(k < n * b, "DOWN").alias("direction"), F.when(n >= LEAST, F.round(stats.normal_p(k, F.nullif(n, F.lit(0)), b), 7)).alias("p"))


@query()
def feature_redundancy(spark, d):
    """ST22: mean absolute correlation and effective rank of the features of cycles.

    Covariances come from one aggregation; the driver gets one row of d * (d + 1) / 2 numbers.
    """
    names = ["ret", "rng", "body", "close_pos", "upper", "lower", "v"]
    rows = features(spark, d).dropna(subset=names)
    pairs = list(itertools.combinations_with_replacement(names, 2))
    got = rows.agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"{a}__{b}") for a, b in pairs)).first()
    cov = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = got[f"{a}__{b}"] or 0.0
    sd = np.sqrt(np.diag(cov))
    some = sd > 1e-12
    corr = cov[np.ix_(some, some)] / np.outer(sd[some], sd[some])
    off = np.abs(corr[~np.eye(len(corr), dtype=bool)])
    s = np.sqrt(np.clip(np.linalg.eigvalsh(cov), 0, None) * max(got["n"] - 1, 0))
    p = s[s > 1e-12] / max(s.sum(), 1e-300)
    row = (int(got["n"]), len(names), int((~some).sum()), round(float(off.mean()), 4) if off.size else 0.0, round(float(np.exp(-(p * np.log(p)).sum())), 4) if p.size else 0.0)
    return spark.createDataFrame([row], "n long, n_dims int, constant_dims int, mean_abs_corr double, effective_rank double")
