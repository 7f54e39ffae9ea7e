"""Momentum score of a window: rates at three distances, confirmed by participants, volume and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import SAMPLES_SQL

#: Windows of an hour stand for windows of five minutes: a second of the score is twelve of the clock.
SECOND = 12_000.0
# Distances in seconds with their weights, and the score from which a direction is given.
SCALES = ((15, 0.25), (30, 0.35), (60, 0.40))
ENTRY, LEAST_POINTS, LEAST_SECONDS = 0.45, 4, 60


def _held(x: str) -> str:
    return f"least(greatest({x}, -1.0), 1.0)"


def _seconds(ms: str) -> str:
    return f"greatest(CAST({ms} AS DOUBLE) / {SECOND:.0f}, 1.0)"


# Score terms as text that both engines read, over the points picked from a window.
_RATES = {f"s{k}": f"CASE WHEN abs(tl - {int(k * SECOND)} - t{k}) < {int(0.8 * k * SECOND)} THEN {_held(f'(vl - v{k}) / {_seconds(f'tl - t{k}')} / 0.5')} END" for k, _ in SCALES}
_TERMS = _RATES | {
    "growth": _held(f"(pl - p0) / {_seconds('tl - t0')} / 2"),
    "speedup": _held(f"((b1 - b0) / {_seconds('tb1 - tb0')} - (a1 - a0) / {_seconds('ta1 - t0')}) / 50"),
    "steps": "sign(vl - vm) + sign(vm - v0) + sign(vl - v0)",
}
_TREND = "CASE WHEN abs(steps) = 3 THEN sign(steps) WHEN steps <> 0 THEN 0.33 * sign(steps) ELSE 0.0 END"
_PULL = f"coalesce(({' + '.join(f'coalesce(s{k} * {w}, 0.0)' for k, w in SCALES)}) / nullif({' + '.join(f'CASE WHEN s{k} IS NULL THEN 0.0 ELSE {w} END' for k, w in SCALES)}, 0.0), 0.0)"
_SCORE = _held(f"({_PULL}) * (1 + (growth + speedup + trend) / 3 * 0.2 + trend * 0.15) * CASE WHEN sd > 15 THEN 0.5 WHEN sd > 8 THEN 0.8 ELSE 1.0 END")
_RESULT = (
    "series", "start", "n", "round(score, 6) AS score", f"CASE WHEN abs(score) < {ENTRY} THEN 'NO_TRADE' WHEN score > 0 THEN 'UP' ELSE 'DOWN' END AS direction",
    f"round(CASE WHEN abs(score) < {ENTRY} THEN 1 - abs(score) / {ENTRY} ELSE 0.5 + 0.5 * (abs(score) - {ENTRY}) / {1 - ENTRY:.2f} END, 6) AS confidence",
)
_NEAR = ", ".join(f"arg_min(pct, (abs(t - (tl - {int(k * SECOND)})), i)) AS v{k}, arg_min(t, (abs(t - (tl - {int(k * SECOND)})), i)) AS t{k}" for k, _ in SCALES)


@query(
    f"""WITH {SAMPLES_SQL}, p AS (SELECT *, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start FROM samples),
o AS (SELECT *, row_number() OVER (PARTITION BY series, start ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY series, start) AS m, max(t) OVER (PARTITION BY series, start) AS tl FROM p),
g AS (SELECT series, start, count(*) AS n, max(tl) AS tl, min(t) AS t0, arg_min(pct, i) AS v0, arg_max(pct, i) AS vl, max(pct) FILTER (i = m // 2) AS vm, stddev_samp(pct) AS sd, {_NEAR}, arg_min(participants, i)::DOUBLE AS p0, arg_max(participants, i)::DOUBLE AS pl,
  max(volume) FILTER (i = 0) AS a0, max(volume) FILTER (i = m // 2 - 1) AS a1, max(t) FILTER (i = m // 2 - 1) AS ta1, max(volume) FILTER (i = m // 2) AS b0, max(t) FILTER (i = m // 2) AS tb0, max(volume) FILTER (i = m - 1) AS b1, max(t) FILTER (i = m - 1) AS tb1
  FROM o GROUP BY 1, 2 HAVING count(*) >= {LEAST_POINTS} AND max(t) - min(t) >= {int(LEAST_SECONDS * SECOND)}),
x AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _TERMS.items())} FROM g), y AS (SELECT *, {_TREND} AS trend FROM x), z AS (SELECT *, {_SCORE} AS score FROM y) SELECT {', '.join(_RESULT)} FROM z"""
)
def momentum_scores(spark, d):
    """DP11: score, direction and confidence of each window with enough points and time."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), src.HOUR_MS))
    point = F.struct("t", "event_id", "pct", F.col("participants").cast("double").alias("people"), "volume")
    w = s.groupBy("series", "start").agg(F.array_sort(F.collect_list(point)).alias("c"), F.count("*").alias("n"), F.stddev_samp("pct").alias("sd"))
    n = F.size("c")
    half = F.floor(n / 2).cast("int")
    first, last, mid, before = (F.get("c", i) for i in (F.lit(0), n - 1, half, half - 1))
    cols = {"t0": first["t"], "tl": last["t"], "v0": first["pct"], "vl": last["pct"], "vm": mid["pct"], "p0": first["people"], "pl": last["people"], "a0": first["volume"], "a1": before["volume"], "ta1": before["t"], "b0": mid["volume"], "tb0": mid["t"], "b1": last["volume"], "tb1": last["t"]}

    def nearest(ms):
        """The first of the points whose time is closest to ms before the last."""
        return F.get("c", F.array_min(F.transform("c", lambda p, i: F.struct(F.abs(p["t"] - (last["t"] - ms)).alias("off"), i.alias("i"))))["i"])

    for k, _ in SCALES:
        near = nearest(int(k * SECOND))
        cols |= {f"v{k}": near["pct"], f"t{k}": near["t"]}
    g = w.filter(n >= LEAST_POINTS).withColumns(cols).filter(F.col("tl") - F.col("t0") >= int(LEAST_SECONDS * SECOND))
    g = g.withColumns({k: F.expr(e) for k, e in _TERMS.items()}).withColumn("trend", F.expr(_TREND)).withColumn("score", F.expr(_SCORE))
    return g.selectExpr(*_RESULT)
