"""Two registries of pre-declared hypotheses on sentiment curves: shapes, levels and streaks; and sentiment against settlement.

A hypothesis is stated for one side; its mirror, with levels at 100 - x, signs turned and outcomes swapped, is made by rule. Every
text is read by both engines, and all hypotheses of a scale are counted in one pass.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.hypotheses import CYCLE_MS, FEATURES_SQL, features
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import HOUR_MS, SAMPLES_SQL

# One row a window: seconds of five minutes are twelve of the clock's here, so half of it is 1,800,000 ms and its last fifth begins at 2,880,000.
_AT, _EARLY = "struct(t, event_id)", "FILTER (WHERE t % 3600000 <= 1800000)"
BASE = {
    "f_start": f"min_by(pct, {_AT})", "f_end": f"max_by(pct, {_AT})", "f_mean": "avg(pct)", "f_max": "max(pct)", "f_min": "min(pct)", "points": "count(*)",
    "hi_share": "avg(CAST(CASE WHEN pct >= 60 THEN 1 ELSE 0 END AS DOUBLE))", "lo_share": "avg(CAST(CASE WHEN pct <= 40 THEN 1 ELSE 0 END AS DOUBLE))", "t_end": f"max_by(pct, {_AT}) {_EARLY}", "t_max": f"max(pct) {_EARLY}", "t_min": f"min(pct) {_EARLY}",
    "tail": f"max_by(pct, {_AT}) FILTER (WHERE t % 3600000 <= 2880000)", "peak_t": "min_by(t % 3600000, struct(-pct, t))", "trough_t": "min_by(t % 3600000, struct(pct, t))",
    "token_in": f"min_by(pct, {_AT}) FILTER (WHERE event_type = 'purchase')", "token_out": f"max_by(pct, {_AT}) FILTER (WHERE event_type = 'purchase')", "chance_in": f"min_by(pct, {_AT}) FILTER (WHERE event_type <> 'purchase')", "chance_out": f"max_by(pct, {_AT}) FILTER (WHERE event_type <> 'purchase')",
}
OWN = {
    "f_range": "f_max - f_min", "delta": "f_end - f_start", "d_head": "t_end - f_start", "d_tail": "f_end - tail", "t_delta": "t_end - f_start", "t_range": "t_max - t_min", "size": "abs(f_end / f_start - 1)",
    "outcome": "CASE WHEN f_end > f_start THEN 'UP' WHEN f_end < f_start THEN 'DOWN' ELSE 'NOISE' END", "wedge_end": "token_out - chance_out", "wedge_change": "(token_out - chance_out) - (token_in - chance_in)",
    "grid": "floor(start / 3600000) % 3", "hour": "floor(start / 3600000) % 24", "weekday": "floor(start / 86400000 + 3) % 7",
}
_W = "OVER (PARTITION BY series ORDER BY start)"


def _rows(f: str, back: int) -> str:
    return f"{f} OVER (PARTITION BY series ORDER BY start ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"


def _run(k: int, side: str) -> str:
    return f"{_rows(f'''sum(CASE WHEN outcome = '{side}' THEN 1 ELSE 0 END)''', k - 1)} = {k} AND start - lag(start, {k - 1}) {_W} = {(k - 1) * HOUR_MS}"


PAST = {
    "prev_out": f"CASE WHEN start - lag(start) {_W} = {HOUR_MS} THEN lag(outcome) {_W} END", "prev_end": f"CASE WHEN start - lag(start) {_W} = {HOUR_MS} THEN lag(f_end) {_W} END", "prev2_end": f"CASE WHEN start - lag(start, 2) {_W} = {2 * HOUR_MS} THEN lag(f_end, 2) {_W} END",
    "next_out": f"CASE WHEN lead(start) {_W} - start = {HOUR_MS} THEN lead(outcome) {_W} END", "next2_out": f"CASE WHEN lead(start, 2) {_W} - start = {2 * HOUR_MS} AND lead(start) {_W} - start = {HOUR_MS} THEN lead(outcome, 2) {_W} END",
    "wrong_rate": f"CASE WHEN {_rows('count(*)', 47)} >= 24 THEN {_rows('''avg(CAST(CASE WHEN (f_end > 50 AND outcome = 'DOWN') OR (f_end < 50 AND outcome = 'UP') THEN 1 ELSE 0 END AS DOUBLE))''', 47)} END",
} | {f"run{k}_{side.lower()}": _run(k, side) for k in (2, 3, 5) for side in ("UP", "DOWN")}


class Part:
    """A condition with its mirror."""

    def __init__(self, text: str, mirror: str):
        self.text, self.mirror = text, mirror

    def __and__(self, other: Part) -> Part:
        return Part(f"{self.text} AND {other.text}", f"{self.mirror} AND {other.mirror}")


def level(column: str, x: float, other: str | None = None) -> Part:
    """column at or above x; mirrored its counterpart at or below 100 - x."""
    return Part(f"{column} >= {x}", f"{other or column} <= {100 - x}")


def move(column: str, x: float) -> Part:
    return Part(f"{column} >= {x}", f"{column} <= -{x}")


def fact(text: str, mirror: str | None = None) -> Part:
    """A condition that is its own mirror unless one is given."""
    return Part(text, mirror or text)


UP, DOWN = fact("outcome = 'UP'", "outcome = 'DOWN'"), fact("outcome = 'DOWN'", "outcome = 'UP'")
_DIFFERS = "prev_out IN ('UP', 'DOWN') AND outcome IN ('UP', 'DOWN') AND prev_out <> outcome"
# Fixed values of the first registry: name, condition, bet (UP, DOWN, SAME as the window, or AGAINST it), the outcome that it is held to.
CURVES = {
    "end_high": (level("f_end", 70), "UP", "next_out"), "mean_high": (level("f_mean", 65), "UP", "next_out"), "touched_extreme": (level("f_max", 90, "f_min"), "AGAINST", "next_out"), "high_twice": (level("f_end", 70) & level("f_max", 90, "f_min"), "UP", "next_out"),
    "rose": (move("delta", 15), "UP", "next_out"), "tail_peak": (fact("peak_t >= 2400000 AND f_end <= f_max - 5", "trough_t >= 2400000 AND f_end >= f_min + 5"), "DOWN", "next_out"), "closed_at_extreme": (fact("points >= 4 AND f_end >= f_max - 2 AND f_range > 5", "points >= 4 AND f_end <= f_min + 2 AND f_range > 5"), "UP", "next_out"),
    "agrees": (UP & level("f_end", 60), "SAME", "next_out"), "diverges": (DOWN & level("f_end", 60), "UP", "next_out"), "crossed": (fact("f_start < 50 AND f_end >= 50 AND delta >= 8", "f_start > 50 AND f_end <= 50 AND delta <= -8"), "UP", "next_out"),
    "run_of_three": (fact("run3_up", "run3_down"), "SAME", "next_out"), "run_of_five": (fact("run5_up", "run5_down"), "SAME", "next_out"), "run_of_two": (fact("run2_up", "run2_down"), "SAME", "next_out"), "end_before_high": (level("prev_end", 70), "UP", "next_out"),
    "early_high": (level("t_end", 70), "UP", "outcome"), "early_rise": (move("t_delta", 10), "UP", "outcome"), "early_touch": (level("t_max", 85, "t_min"), "UP", "outcome"), "early_confirms": (fact("prev_out = 'UP'", "prev_out = 'DOWN'") & level("t_end", 60), "UP", "outcome"), "early_denies": (fact("prev_out = 'DOWN'", "prev_out = 'UP'") & level("t_end", 60), "UP", "outcome"),
}
# Conditions without a mirror.
PLAIN = {
    "no_consensus": ("f_end >= 40 AND f_end <= 60", "SAME", "next_out"), "flat": ("f_range <= 5", "SAME", "next_out"), "early_flat": ("t_range <= 3", "SAME", "next_out"), "large_move": ("size >= large", "AGAINST", "next_out"), "tiny_move": ("size <= large / 2", "SAME", "next_out"), "just_turned": (_DIFFERS, "AGAINST", "next_out"),
    "asia": ("hour < 8", "SAME", "next_out"), "europe": ("hour >= 8 AND hour < 16", "SAME", "next_out"), "america": ("hour >= 16", "SAME", "next_out"), "weekend": ("weekday >= 5", "SAME", "next_out"), "first_of_cycle": ("grid = 0", "SAME", "next_out"), "last_of_cycle": ("grid = 2", "SAME", "next_out"),
}
# Fixed values of the second registry: sentiment that settlement contradicts, and controls that agree.
X3, X3_BEFORE = DOWN & level("f_end", 60), fact("prev_out = 'DOWN'", "prev_out = 'UP'") & level("prev_end", 60)
OVER, OVER_BEFORE = DOWN & fact("f_end > 50", "f_end < 50"), fact("prev_out = 'DOWN' AND prev_end > 50", "prev_out = 'UP' AND prev_end < 50")
MISALIGNED = (
    {f"wrong_end_{x}": (DOWN & level("f_end", x), "UP", "next_out") for x in (60, 70)}
    | {"agreeing_end": (UP & level("f_end", 60), "UP", "next_out"), "agreeing_rise": (UP & move("delta", 20), "UP", "next_out")}
    | {f"wrong_rise_{x}": (DOWN & move("delta", x), "UP", "next_out") for x in (10, 15, 20)}
    | {f"wrong_tail_{x}": (DOWN & move("d_tail", x), "UP", "next_out") for x in (5, 10)}
    | {
        "ends_rise_yet_down": (DOWN & fact("f_end > prev_end AND prev_end > prev2_end", "f_end < prev_end AND prev_end < prev2_end"), "UP", "next_out"), "disbelieved_run": (fact("run2_up AND f_end <= 45", "run2_down AND f_end >= 55"), "UP", "next_out"),
        "dear_token": (move("wedge_end", 2), "DOWN", "next_out"), "wedge_opens": (move("wedge_change", 2), "DOWN", "next_out"), "wrong_at_cycle_end": (X3 & fact("grid = 2"), "UP", "next_out"), "late_flip": (fact("f_start >= 50 AND d_head > 0 AND f_end <= 45", "f_start < 50 AND d_head < 0 AND f_end >= 55"), "DOWN", "next_out"),
        "wrong_twice": (X3 & X3_BEFORE, "UP", "next_out"), "overrated_twice_mends": (OVER & OVER_BEFORE, "UP", "next_out"), "overrated_twice_lasts": (OVER & OVER_BEFORE, "DOWN", "next_out"), "settlement_is_right": (DOWN & level("f_max", 90, "f_min"), "DOWN", "next_out"),
        "half_believed": (UP & fact("f_end >= 45 AND f_end <= 55"), "UP", "next_out"), "unnoticed": (UP & fact("f_range <= 5"), "UP", "next_out"), "spoiled": (DOWN & fact("f_max >= 90 AND f_end <= 80", "f_min <= 10 AND f_end >= 20"), "DOWN", "next_out"), "wrong_days": (fact("wrong_rate >= 0.55") & level("f_end", 60), "DOWN", "next_out"),
        "mends_later": (X3, "UP", "next2_out"), "opening_denies": (fact("prev_out = 'DOWN'", "prev_out = 'UP'") & level("f_start", 55), "UP", "next_out"), "tug_of_war": (UP & fact("hi_share >= 0.2 AND lo_share >= 0.2"), "DOWN", "next_out"), "crack": (level("f_end", 70) & fact("d_tail < 0", "d_tail > 0"), "DOWN", "next_out"),
        "anchor_run": (fact("run3_up", "run3_down"), "UP", "next_out"), "anchor_level": (level("f_end", 70), "UP", "next_out"),
    }
)
_TURNED = {"UP": "DOWN", "DOWN": "UP"}


def both_sides(stated: dict) -> dict[str, tuple[str, str, str]]:
    """name -> (condition, bet, target) of each hypothesis and its mirror."""
    out = {}
    for name, (part, bet, target) in stated.items():
        out[name] = (part.text, bet, target)
        out[f"{name}_mirrored"] = (part.mirror, _TURNED.get(bet, bet), target)
    return out


REGISTRIES = {"curves": both_sides(CURVES) | PLAIN, "misaligned": both_sides(MISALIGNED)}
# Conditions on cycles of three windows: the features of `bar_hypotheses`, held to the next cycle.
CYCLES = {
    "end_high": ("c >= 0.7", "UP"), "end_low": ("c <= 0.3", "DOWN"), "three_up": ("path = 'UUU'", "SAME"), "three_down": ("path = 'DDD'", "SAME"), "two_up_one_down": ("path = 'UUD'", "DOWN"), "two_down_one_up": ("path = 'DDU'", "UP"), "two_cycles_up": ("d > 0 AND d1 > 0", "SAME"), "two_cycles_down": ("d < 0 AND d1 < 0", "SAME"),
    "rose_much": ("c - o >= 0.2", "UP"), "fell_much": ("c - o <= -0.2", "DOWN"), "large_move": ("abs(ret) >= large", "AGAINST"), "asia": ("(cycle_ts / 3600000) % 24 < 8", "SAME"), "america": ("(cycle_ts / 3600000) % 24 >= 16", "SAME"), "closed_high_and_up": ("d > 0 AND close_pos >= 0.85", "UP"), "closed_low_and_down": ("d < 0 AND close_pos <= 0.15", "DOWN"),
}
#: Share of the discovery part below which a move is not large; sizes are rounded, so that few values are held.
LARGE = 0.8


def bet_of(bet: str, outcome: str) -> str:
    return {"SAME": outcome, "AGAINST": f"CASE {outcome} WHEN 'UP' THEN 'DOWN' WHEN 'DOWN' THEN 'UP' END"}.get(bet, f"'{bet}'")


def _all() -> list[tuple[str, str, str, str, str]]:
    return [(registry, name, condition, bet, target) for registry, names in REGISTRIES.items() for name, (condition, bet, target) in names.items()]


def _duck(text: str) -> str:
    return text.replace("min_by(", "arg_min(").replace("max_by(", "arg_max(").replace("struct(", "(")


WINDOWS_SQL = f"""{SAMPLES_SQL}, w0 AS (SELECT series, CAST(floor(t / {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS start, {', '.join(f'{_duck(e)} AS {k}' for k, e in BASE.items())} FROM samples GROUP BY 1, 2), w1 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in OWN.items())} FROM w0), w2 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in PAST.items())} FROM w1),
cut AS (SELECT quantile_cont(round(size, 3), {LARGE}) AS large FROM w2 WHERE start < {HALF}), win AS (SELECT * FROM w2, cut)"""


def windows(spark, d):
    """One row a window with everything that the registries look at."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), HOUR_MS))
    mean = stats.sum_in_order("pct", "event_id") / F.count("pct")
    w = s.groupBy("series", "start").agg(*((mean if k == "f_mean" else F.expr(e)).alias(k) for k, e in BASE.items())).selectExpr("*", *(f"{e} AS {k}" for k, e in OWN.items()))
    w = w.selectExpr("*", *(f"{e} AS {k}" for k, e in PAST.items()))
    cut = stats.percentiles(w.filter(F.col("start") < HALF), {"size": F.round("size", 3)}, {"large": ("size", LARGE)})
    return w.join(F.broadcast(cut))  # one row


def _counts(condition: str, bet: str, target: str, outcome: str) -> tuple[str, str]:
    """What counts as a case, and as a right one."""
    case = f"({condition}) AND {target} IN ('UP', 'DOWN') AND {bet_of(bet, outcome)} IN ('UP', 'DOWN')"
    return case, f"{case} AND {target} = {bet_of(bet, outcome)}"


_CYCLE_NEXT = "CASE WHEN next_d > 0 THEN 'UP' ELSE 'DOWN' END"
_CYCLE_OUT = "CASE WHEN d > 0 THEN 'UP' WHEN d < 0 THEN 'DOWN' END"
_SHOWN = "CASE WHEN n > 0 THEN round(least(1.0, 2 * " + stats.normal_cdf_sql("(-greatest((abs(k - n * base) - 0.5) / sqrt(n * base * (1 - base)), 0))") + "), 7) END"


def _union() -> str:
    parts = []
    for registry, name, condition, bet, target in _all():
        case, right = _counts(condition, bet, target, "outcome")
        base = {"UP": "share", "DOWN": "1 - share"}.get(bet, "0.5::DOUBLE")
        parts.append(f"SELECT '{registry}' AS registry, '{name}' AS hypothesis, '{bet}' AS bet, count(*) FILTER ({case}) AS n, count(*) FILTER ({right}) AS k, (SELECT {base} FROM share WHERE target = '{target}') AS base FROM win")
    for name, (condition, bet) in CYCLES.items():
        case, right = _counts(condition, bet, f"({_CYCLE_NEXT})", f"({_CYCLE_OUT})")
        base = {"UP": "share", "DOWN": "1 - share"}.get(bet, "0.5::DOUBLE")
        parts.append(f"SELECT 'cycles', '{name}', '{bet}', count(*) FILTER ({case}), count(*) FILTER ({right}), (SELECT {base} FROM share WHERE target = 'cycle') FROM cyc")
    return " UNION ALL ".join(parts)


_TARGETS = ("outcome", "next_out", "next2_out")


@query(
    f"""WITH {FEATURES_SQL}, clarge AS (SELECT quantile_cont(round(abs(ret), 3), {LARGE}) AS large FROM feats WHERE cycle_ts < {HALF}), cyc AS (SELECT * FROM feats, clarge), {WINDOWS_SQL.removeprefix(SAMPLES_SQL + ', ')},
share AS ({' UNION ALL '.join(f"SELECT '{t}' AS target, count(*) FILTER ({t} = 'UP') / nullif(count(*) FILTER ({t} IN ('UP', 'DOWN')), 0) AS share FROM win" for t in _TARGETS)} UNION ALL SELECT 'cycle', count(*) FILTER (next_d > 0) / nullif(count(*), 0) FROM cyc), h AS ({_union()})
SELECT registry, hypothesis, bet, n, k, round(base, 6) AS base, CASE WHEN n > 0 THEN round(k / n, 6) END AS rate, {_SHOWN} AS p FROM h"""
)
def declared_hypotheses(spark, d):
    """DP23, DP24: both registries, and that of cycles: cases, right bets, base rate of the bet's side and two-sided p. A bet is on a side, on or
    against the window's own, and held to the next window, the one after it, or (early reads) to the window itself."""
    w = windows(spark, d)
    rows, aggs, cells = _all(), [], []
    for i, (registry, name, condition, bet, target) in enumerate(rows):
        case, right = _counts(condition, bet, target, "outcome")
        aggs += [F.count_if(F.expr(case)).alias(f"n{i}"), F.count_if(F.expr(right)).alias(f"k{i}")]
        share = F.col(f"up_{target}")
        base = {"UP": share, "DOWN": 1 - share}.get(bet, F.lit(0.5))
        cells.append(F.struct(F.lit(registry).alias("registry"), F.lit(name).alias("hypothesis"), F.lit(bet).alias("bet"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k"), base.alias("base")))
    shares = [(F.count_if(F.col(t) == "UP") / F.nullif(F.count_if(F.col(t).isin("UP", "DOWN")), F.lit(0))).alias(f"up_{t}") for t in _TARGETS]
    a = w.agg(*aggs, *shares).select(F.inline(F.array(*cells)))
    c = features(spark, d)
    large = stats.percentiles(c.filter(F.col("cycle_ts") < HALF), {"ret": F.round(F.abs("ret"), 3)}, {"large": ("ret", LARGE)})
    c = c.join(F.broadcast(large))  # one row
    aggs, cells = [], []
    for i, (name, (condition, bet)) in enumerate(CYCLES.items()):
        case, right = _counts(condition, bet, f"({_CYCLE_NEXT})", f"({_CYCLE_OUT})")
        aggs += [F.count_if(F.expr(case)).alias(f"n{i}"), F.count_if(F.expr(right)).alias(f"k{i}")]
        base = {"UP": F.col("up"), "DOWN": 1 - F.col("up")}.get(bet, F.lit(0.5))
        cells.append(F.struct(F.lit("cycles").alias("registry"), F.lit(name).alias("hypothesis"), F.lit(bet).alias("bet"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k"), base.alias("base")))
    b = c.agg(*aggs, (F.count_if(F.col("next_d") > 0) / F.nullif(F.count("*"), F.lit(0))).alias("up")).select(F.inline(F.array(*cells)))
    n, k = F.col("n"), F.col("k")
    p = F.when(n > 0, F.round(stats.normal_p(k, F.nullif(n, F.lit(0)), F.col("base")), 7))
    return a.unionByName(b).select("registry", "hypothesis", "bet", "n", "k", r6("base").alias("base"), r6(k / F.nullif(n, F.lit(0))).alias("rate"), p.alias("p"))


__all__ = ["CYCLE_MS", "REGISTRIES", "both_sides", "declared_hypotheses"]
