"""Queries that predict: three-channel window views, the predicate catalogue, mined, screened and resolved hypotheses."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import curves, ev, stats
from tidemark.operators.bootstrap import draws_sql, ratio_intervals
from tidemark.operators.shared import written
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import HOUR_MS, SAMPLES_SQL

CHANNELS, SEGMENTS, SYMBOLS = ("crowd", "quote", "volume"), ("early", "mid", "late"), curves.SYMBOLS
_UP, _DOWN = ("surge", "rise"), ("dip", "drop")
_VALUES = {"crowd": "CAST(participants AS DOUBLE)", "quote": "pct", "volume": "volume"}
# Reach of the local baseline, least hits, list length, false discovery rate, least bets, decision point, least live samples, resamples.
BASE_MS, MIN_HITS, MOST_HINTS, FDR_Q, MIN_FIRES, DECISION_MS, MIN_LIVE, DRAWS = 3 * 24 * HOUR_MS, 5, 60, 0.1, 10, 1_800_000, 20, 2000
PAIRS = list(permutations(CHANNELS, 2))
WHOLE_MS = HOUR_MS


def enumerate_predicates() -> dict[str, str]:
    """DP12: every single predicate as a condition on a view, by name: 45 + 120 + 75 + 24 + 9 + 9 + 12 of them."""
    out = {f"{c} {seg} {s}": f"{c}_{seg}_{s} >= 1 AND 2 * {c}_{seg}_{s} >= {seg}_n" for c, seg, s in product(CHANNELS, SEGMENTS, SYMBOLS)}
    out |= {f"{c} {s} {op} {k}": f"{c}_{s} {op} {k}" for c, s, op, k in product(CHANNELS, SYMBOLS, (">=", "<="), (1, 2, 3, 4))}
    out |= {f"{c} {a} then {b}": f"array_contains({c}_pairs, '{a} {b}')" for c, a, b in product(CHANNELS, SYMBOLS, SYMBOLS)}
    out |= {f"{c} peaks {op} {k}": f"{c}_peaks {op} {k}" for c, op, k in product(CHANNELS, (">=", "="), (1, 2, 3, 4))}
    out |= {f"{c} spacing {t}": f"{c}_spacing = '{t}'" for c, t in product(CHANNELS, ("shrinking", "expanding", "mixed"))}
    out |= {f"{a} with {b} >= {x}": f"sync_{a}_{b} >= {x}" for (a, b), x in product(PAIRS, (0.5, 0.6, 0.7)) if a < b}
    return out | {f"{a} leads {b} by {k}": f"lead_{a}_{b}_{k} >= 1" for (a, b), k in product(PAIRS, (1, 2))}


PREDICATES = enumerate_predicates()
NAMES, CONDITIONS = list(PREDICATES), list(PREDICATES.values())
_LO = {"early": "0", "mid": "third", "late": "least(m - 1, two)"}
_HI = {"early": "greatest(1, third)", "mid": "greatest(third + 1, two)", "late": "m"}


def views_sql(until: int) -> str:
    """The common table expressions of `views` for DuckDB."""
    each = lambda f, sep=", ": sep.join(f(c) for c in CHANNELS)
    symbol = lambda c: f"CASE WHEN dl_{c} IS NULL THEN NULL WHEN dl_{c} < e_{c}[1] THEN 'drop' WHEN dl_{c} < e_{c}[2] THEN 'dip' WHEN dl_{c} < e_{c}[3] THEN 'flat' WHEN dl_{c} < e_{c}[4] THEN 'rise' ELSE 'surge' END AS s_{c}"
    aggs = [f"count(*) FILTER (s_{c} = '{s}') AS {c}_{s}" for c in CHANNELS for s in SYMBOLS]
    aggs += [f"count(*) FILTER (s_{c} = '{s}' AND i - 1 >= {_LO[g]} AND i - 1 < {_HI[g]}) AS {c}_{g}_{s}" for c in CHANNELS for g in SEGMENTS for s in SYMBOLS]
    aggs += [f"list_distinct(list(ps_{c} || ' ' || s_{c}) FILTER (ps_{c} IS NOT NULL)) AS {c}_pairs, count(*) FILTER (x_{c}) AS {c}_peaks, list(i ORDER BY i) FILTER (x_{c}) AS {c}_at, coalesce(sum(abs(dl_{c})), 0) AS {c}_way, arg_max(y_{c}, i) - arg_min(y_{c}, i) AS {c}_net" for c in CHANNELS]
    aggs += [f"count(*) FILTER (d_{a} = d_{b}) / any_value(m) AS sync_{a}_{b}" for a, b in PAIRS if a < b] + [f"count(*) FILTER (tr_{a} AND n{k}_{b}) AS lead_{a}_{b}_{k}" for a, b in PAIRS for k in (1, 2)]
    gaps = lambda c: f"list_transform(range(1, len({c}_at)), lambda j: {c}_at[j + 1] - {c}_at[j])"
    turn = lambda c, op: f"len(list_filter(range(1, len({c}_gaps)), lambda j: {c}_gaps[j + 1] {op} {c}_gaps[j]))"
    w = "(PARTITION BY series, start ORDER BY t, event_id)"
    return f"""{SAMPLES_SQL}, x0 AS (SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, t, event_id, event_type, q, {each(lambda c: f'{_VALUES[c]} AS y_{c}')} FROM samples),
x1 AS (SELECT *, first_value(y_quote) OVER f AS q_in, last_value(y_quote) OVER f AS q_out FROM x0 WINDOW f AS (PARTITION BY series, start ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x2 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series, start) - 1 AS m, {each(lambda c: f'y_{c} - lag(y_{c}) OVER w AS dl_{c}, coalesce((y_{c} > lag(y_{c}) OVER w AND y_{c} > lead(y_{c}) OVER w) OR (y_{c} < lag(y_{c}) OVER w AND y_{c} < lead(y_{c}) OVER w), false) AS x_{c}')} FROM x1 WHERE t - start < {until} WINDOW w AS {w}),
edges AS (SELECT series, {each(lambda c: f'quantile_cont(dl_{c}, [0.2, 0.4, 0.6, 0.8]) AS e_{c}')} FROM x2 WHERE start < {HALF} GROUP BY 1 HAVING count(dl_quote) >= 10),
x3 AS (SELECT x2.*, CAST(round_even(m / 3, 0) AS BIGINT) AS third, CAST(round_even(2 * m / 3, 0) AS BIGINT) AS two, {each(symbol)} FROM x2 JOIN edges USING (series) WHERE m >= 1),
x4 AS (SELECT *, {each(lambda c: f"lag(s_{c}) OVER w AS ps_{c}, coalesce(s_{c} <> lag(s_{c}) OVER w, false) AS tr_{c}, CASE WHEN s_{c} IN {_UP} THEN 'U' WHEN s_{c} IN {_DOWN} THEN 'D' WHEN s_{c} = 'flat' THEN 'F' END AS d_{c}")} FROM x3 WINDOW w AS {w}),
x5 AS (SELECT *, {each(lambda c: f'tr_{c} OR lead(tr_{c}, 1, false) OVER w OR lead(tr_{c}, 2, false) OVER w AS n1_{c}, lead(tr_{c}, 1, false) OVER w OR lead(tr_{c}, 2, false) OVER w OR lead(tr_{c}, 3, false) OVER w AS n2_{c}')} FROM x4 WINDOW w AS {w}),
x6 AS (SELECT series, start, any_value(m) AS m, any_value(third) AS third, any_value(two) AS two, CASE WHEN any_value(q_out) > any_value(q_in) THEN 'UP' WHEN any_value(q_out) < any_value(q_in) THEN 'DOWN' ELSE 'NOISE' END AS outcome,
  arg_max(q, i) AS last_q, arg_max(q, i) FILTER (event_type = 'purchase') AS real_q, {', '.join(aggs)} FROM x5 GROUP BY 1, 2),
x7 AS (SELECT *, {', '.join(f'least({_HI[g]}, m) - {_LO[g]} AS {g}_n' for g in SEGMENTS)}, {each(lambda c: f'{gaps(c)} AS {c}_gaps')} FROM x6),
views AS (SELECT *, {each(lambda c: f"CASE WHEN coalesce(len({c}_at), 0) < 3 THEN 'insufficient' WHEN {turn(c, '<')} > 0.6 * (len({c}_gaps) - 1) THEN 'shrinking' WHEN {turn(c, '>')} > 0.6 * (len({c}_gaps) - 1) THEN 'expanding' ELSE 'mixed' END AS {c}_spacing, CASE WHEN abs({c}_net) > 1e-12 THEN {c}_way / abs({c}_net) WHEN {c}_way = 0 THEN 1.0 ELSE least({c}_way, 99.0) END AS {c}_curl")} FROM x7)"""


def spacing(at: Column) -> Column:
    """AF10: how the gaps between extrema change; insufficient below three of them."""
    turns = curves.deltas(curves.deltas(F.transform(at, lambda x: x.cast("double"))))
    share = lambda keep: F.size(F.filter(turns, keep)) > 0.6 * F.size(turns)
    return F.when(F.size(at) < 3, "insufficient").when(share(lambda x: x < 0), "shrinking").when(share(lambda x: x > 0), "expanding").otherwise("mixed")


def views(spark, d, until: int = WHOLE_MS):
    """One row for each window with what predicates look at, of its samples before `until` ms; edges of the
    symbols are frozen on the first half of the time. No array is longer than a window's extrema."""
    w, whole = Window.partitionBy("series", "start").orderBy("t", "event_id"), Window.partitionBy("series", "start")
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), HOUR_MS)).withColumns({f"y_{c}": F.expr(v) for c, v in _VALUES.items()})
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"q_in": F.first("y_quote").over(ends), "q_out": F.last("y_quote").over(ends)}).filter(F.col("t") - F.col("start") < until)

    def extreme(y: str) -> Column:
        before, after, y = F.lag(y).over(w), F.lead(y).over(w), F.col(y)
        return F.coalesce(((y > before) & (y > after)) | ((y < before) & (y < after)), F.lit(False))

    s = s.withColumns({"i": F.row_number().over(w) - 1, "m": F.count("*").over(whole) - 1} | {f"dl_{c}": F.col(f"y_{c}") - F.lag(f"y_{c}").over(w) for c in CHANNELS} | {f"x_{c}": extreme(f"y_{c}") for c in CHANNELS})
    edges = s.filter(F.col("start") < HALF).groupBy("series").agg(F.count("dl_quote").alias("k"), *(F.sort_array(F.collect_list(f"dl_{c}")).alias(f"all_{c}") for c in CHANNELS)).filter("k >= 10")
    edges = edges.select("series", *(stats.quantiles(F.col(f"all_{c}"), (0.2, 0.4, 0.6, 0.8)).alias(f"e_{c}") for c in CHANNELS))
    s = s.filter("m >= 1").join(edges, "series").withColumns({"third": F.bround(F.col("m") / 3).cast("long"), "two": F.bround(2 * F.col("m") / 3).cast("long")})
    s = s.withColumns({f"s_{c}": F.when(F.col(f"dl_{c}").isNotNull(), curves.symbol(F.col(f"dl_{c}"), F.col(f"e_{c}"))) for c in CHANNELS})
    for c in CHANNELS:
        now, before = F.col(f"s_{c}"), F.lag(f"s_{c}").over(w)
        s = s.withColumns({f"ps_{c}": before, f"tr_{c}": F.coalesce(now != before, F.lit(False)), f"d_{c}": F.when(now.isin(*_UP), "U").when(now.isin(*_DOWN), "D").when(now == "flat", "F")})
    after = lambda c, k: F.lead(f"tr_{c}", k, False).over(w)
    s = s.withColumns({f"n1_{c}": F.col(f"tr_{c}") | after(c, 1) | after(c, 2) for c in CHANNELS} | {f"n2_{c}": after(c, 1) | after(c, 2) | after(c, 3) for c in CHANNELS})
    q_out, q_in = F.first("q_out"), F.first("q_in")
    aggs = [F.first(x).alias(x) for x in ("m", "third", "two")] + [src.outcome(q_out - q_in).alias("outcome"), F.max_by("q", "i").alias("last_q"), F.max_by(F.when(F.col("event_type") == "purchase", F.col("q")), F.when(F.col("event_type") == "purchase", F.col("i"))).alias("real_q")]
    aggs += [F.count_if(F.col(f"s_{c}") == x).alias(f"{c}_{x}") for c in CHANNELS for x in SYMBOLS]
    aggs += [F.count_if((F.col(f"s_{c}") == x) & F.expr(f"i - 1 >= {_LO[g]} AND i - 1 < {_HI[g]}")).alias(f"{c}_{g}_{x}") for c in CHANNELS for g in SEGMENTS for x in SYMBOLS]
    for c in CHANNELS:
        y = f"y_{c}"
        aggs += [F.collect_set(F.when(F.col(f"ps_{c}").isNotNull(), F.concat_ws(" ", f"ps_{c}", f"s_{c}"))).alias(f"{c}_pairs"), F.count_if(f"x_{c}").alias(f"{c}_peaks"), F.array_sort(F.collect_list(F.when(F.col(f"x_{c}"), F.col("i")))).alias(f"{c}_at")]
        aggs += [F.coalesce(F.sum(F.abs(f"dl_{c}")), F.lit(0.0)).alias(f"{c}_way"), (F.max_by(y, "i") - F.min_by(y, "i")).alias(f"{c}_net")]
    aggs += [(F.count_if(F.col(f"d_{a}") == F.col(f"d_{b}")) / F.first("m")).alias(f"sync_{a}_{b}") for a, b in PAIRS if a < b]
    aggs += [F.count_if(F.col(f"tr_{a}") & F.col(f"n{k}_{b}")).alias(f"lead_{a}_{b}_{k}") for a, b in PAIRS for k in (1, 2)]
    v = s.groupBy("series", "start").agg(*aggs).withColumns({f"{g}_n": F.expr(f"least({_HI[g]}, m) - {_LO[g]}") for g in SEGMENTS})
    curl = lambda c: F.when(F.abs(f"{c}_net") > 1e-12, F.col(f"{c}_way") / F.abs(f"{c}_net")).when(F.col(f"{c}_way") == 0, 1.0).otherwise(F.least(F.col(f"{c}_way"), F.lit(99.0)))
    return v.withColumns({f"{c}_spacing": spacing(F.col(f"{c}_at")) for c in CHANNELS} | {f"{c}_curl": curl(c) for c in CHANNELS})


_SHOWN = ["series", "start", "m", "outcome", "early_n", "mid_n", "late_n"] + [f"{c}_{x}" for c in CHANNELS for x in ("peaks", "spacing", "early_flat", "mid_rise", "late_dip")]
_ROUNDED = [f"{c}_curl" for c in CHANNELS] + [f"sync_{a}_{b}" for a, b in PAIRS if a < b]
_LEADS = [f"lead_{a}_{b}_{k}" for a, b in PAIRS for k in (1, 2)]


@query(f"WITH {views_sql(WHOLE_MS)} SELECT {', '.join(_SHOWN)}, {', '.join(f'round({x}, 6) AS {x}' for x in _ROUNDED)}, {', '.join(_LEADS)} FROM views")
def window_views(spark, d):
    """AF9, AF10, AF11, AF12, AF14, AF16, AF17: geometry of each channel, symbols by third, synchrony and leads between channels."""
    return views(spark, d).select(*_SHOWN, *(r6(x).alias(x) for x in _ROUNDED), *_LEADS)


def _judge(g: pd.DataFrame) -> pd.DataFrame:
    """Counts of every predicate over one series' windows."""
    g = g.sort_values("start")
    hit, start, outcome = np.stack(g["flags"].to_numpy()).astype(bool), g["start"].to_numpy(np.float64)[:, None], g["outcome"].to_numpy()
    before = np.maximum.accumulate(np.where(hit, start, -np.inf), axis=0)
    after = np.minimum.accumulate(np.where(hit, start, np.inf)[::-1], axis=0)[::-1]
    pool = ~hit & ((start - before <= BASE_MS) | (after - start <= BASE_MS))
    up, down = (outcome == "UP")[:, None], (outcome == "DOWN")[:, None]
    cols = {"hits": hit, "up_hits": hit & up, "down_hits": hit & down, "base": pool, "up_base": pool & up, "down_base": pool & down}
    return pd.DataFrame({"predicate": np.arange(hit.shape[1], dtype=np.int32)} | {k: x.sum(axis=0) for k, x in cols.items()})


def judged(v, when: Column):
    """JN17, JN12: every predicate over the windows of a period: hits by outcome, and those of the local baseline, which
    are the windows of a series within three days of a hit that are not hits themselves.

    A group is one series' windows, at most one an hour, with 294 flags each: a year of them takes 3 MB. Exploded to
    rows instead, each window would be sorted 294 times.
    """
    flags = F.array(*(F.coalesce(F.expr(c), F.lit(False)) for c in CONDITIONS))
    counts = ["hits", "up_hits", "down_hits", "base", "up_base", "down_base"]
    rows = v.filter(when).select("series", "start", "outcome", flags.alias("flags"))
    per = rows.groupBy("series").applyInPandas(_judge, "predicate int, " + ", ".join(f"{c} long" for c in counts))
    return per.groupBy("predicate").agg(*(F.sum(c).alias(c) for c in counts))


def judged_sql(when: str) -> str:
    flags = ", ".join(f"coalesce({c}, false)" for c in CONDITIONS)
    return f"""flags AS (SELECT series, start, outcome, unnest([{flags}]) AS hit, unnest(range({len(CONDITIONS)})) AS predicate FROM views WHERE {when}),
near AS (SELECT *, last_value(CASE WHEN hit THEN start END IGNORE NULLS) OVER (PARTITION BY predicate, series ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4, first_value(CASE WHEN hit THEN start END IGNORE NULLS) OVER (PARTITION BY predicate, series ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft FROM flags),
pooled AS (SELECT *, NOT hit AND (coalesce(start - b4 <= {BASE_MS}, false) OR coalesce(aft - start <= {BASE_MS}, false)) AS pool FROM near),
judged AS (SELECT CAST(predicate AS INTEGER) AS predicate, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND outcome = 'UP') AS up_hits, count(*) FILTER (hit AND outcome = 'DOWN') AS down_hits,
  count(*) FILTER (pool) AS base, count(*) FILTER (pool AND outcome = 'UP') AS up_base, count(*) FILTER (pool AND outcome = 'DOWN') AS down_base FROM pooled GROUP BY 1)"""


def lift_sql(a: str, n: str, b: str, m: str) -> tuple[str, str]:
    """Lift and standard error of its logarithm as text; 0 where degenerate."""
    ok = f"{a} > 0 AND {n} > 0 AND {b} > 0 AND {m} > 0"
    return f"CASE WHEN {ok} THEN ({a} / {n}) / ({b} / {m}) ELSE 0.0 END", f"CASE WHEN {ok} THEN sqrt(greatest(1 / {a} - 1 / {n} + 1 / {b} - 1 / {m}, 1e-12)) ELSE 0.0 END"


_UPL, _UPS = lift_sql("up_hits", "hits", "up_base", "base")
_DNL, _DNS = lift_sql("down_hits", "hits", "down_base", "base")
_HINTS_SQL = f"""{views_sql(WHOLE_MS)}, {judged_sql(f'start < {HALF}')}, l AS (SELECT *, {_UPL} AS ul, {_UPS} AS us, {_DNL} AS dl, {_DNS} AS ds FROM judged WHERE hits >= {MIN_HITS}),
hints AS (SELECT predicate, CASE WHEN dl > ul THEN 'DOWN' ELSE 'UP' END AS direction, hits, up_hits, down_hits, hits - up_hits - down_hits AS noise_hits, round(greatest(ul, dl), 3) AS lift,
  CASE WHEN greatest(ul, dl) > 0 THEN round(exp(ln(greatest(ul, dl)) - 1.96 * CASE WHEN dl > ul THEN ds ELSE us END), 3) ELSE 0 END AS ci_lower FROM l)"""


def hints(v):
    """DP13: of each predicate with enough hits in the first half the direction of the larger lift."""
    j = judged(v, F.col("start") < HALF).filter(F.col("hits") >= MIN_HITS)
    for side in ("up", "down"):
        j = j.withColumn(side, stats.lift(F.col(f"{side}_hits"), F.col("hits"), F.col(f"{side}_base"), F.col("base")))
    best = F.when(F.col("down.lift") > F.col("up.lift"), F.col("down")).otherwise(F.col("up"))
    noise = F.col("hits") - F.col("up_hits") - F.col("down_hits")
    return j.select("predicate", F.when(F.col("down.lift") > F.col("up.lift"), "DOWN").otherwise("UP").alias("direction"), "hits", "up_hits", "down_hits", noise.alias("noise_hits"), F.round(best["lift"], 3).alias("lift"), F.round(best["lo"], 3).alias("ci_lower"))


@query(f"WITH {_HINTS_SQL} SELECT * FROM hints ORDER BY lift DESC, hits DESC, predicate LIMIT {MOST_HINTS}")
def mined_hints(spark, d):
    """DP12, DP13, JN12, JN17, WF34: the 294 single predicates over the first half; the 60 with the largest lift (the list is the feature)."""
    return hints(views(spark, d)).orderBy(F.desc("lift"), F.desc("hits"), "predicate").limit(MOST_HINTS)


def entry_price(direction: str) -> tuple[Column, Column]:
    """EV10: price and kind at the decision point: a real token's price, else the chance, else missing."""
    of = (lambda q: q) if direction == "UP" else (lambda q: 1 - q)
    return F.coalesce(of(F.col("real_q")), of(F.col("last_q"))), F.when(F.col("real_q").isNotNull(), "real").when(F.col("last_q").isNotNull(), "proxy").otherwise("missing")


_GAIN = "CASE WHEN win THEN 0.98 / least(greatest(price + 0.01, 0.01), 0.99) - 1 ELSE -1 END"


def _fires_sql() -> str:
    return f"""fired AS (SELECT predicate, series, start, side, outcome = side AS win, CASE WHEN side = 'UP' THEN coalesce(real_q, last_q) ELSE 1 - coalesce(real_q, last_q) END AS price, real_q IS NOT NULL AS is_real
  FROM flags JOIN (SELECT series, start, real_q, last_q FROM views) USING (series, start), (VALUES ('UP'), ('DOWN')) s(side) WHERE hit AND outcome <> 'NOISE'),
gate AS (SELECT CAST(predicate AS INTEGER) AS predicate, side, count(*) AS fires, count(*) FILTER (is_real) AS n_real, avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS win_rate, avg(price) AS mean_price, avg(pnl) AS ev, avg(pnl) - 1.96 * stddev_samp(pnl) / sqrt(count(*)) AS normal_low
  FROM (SELECT *, {_GAIN} AS pnl FROM fired) GROUP BY 1, 2)"""


def _drawn_gate_sql() -> str:
    """`gate` with the bootstrap's ends as ev_low and ev_high, null below MIN_FIRES bets."""
    return f"""{_fires_sql()}, pair AS (SELECT predicate, series, start // {HOUR_MS} AS hour, max({_GAIN}) FILTER (side = 'UP') AS up, max({_GAIN}) FILTER (side = 'DOWN') AS down FROM fired GROUP BY 1, 2, 3),
{draws_sql('pair', ['series', 'hour'], DRAWS)}, sums AS (SELECT predicate, r, sum(w * up) / nullif(sum(w), 0) AS up, sum(w * down) / nullif(sum(w), 0) AS down FROM pair JOIN drawn USING (series, hour) GROUP BY 1, 2),
ends AS (SELECT CAST(predicate AS INTEGER) AS predicate, 'UP' AS side, quantile_cont(up, 0.025) AS lo, quantile_cont(up, 0.975) AS hi FROM sums GROUP BY 1 UNION ALL SELECT CAST(predicate AS INTEGER), 'DOWN', quantile_cont(down, 0.025), quantile_cont(down, 0.975) FROM sums GROUP BY 1),
drawn_gate AS (SELECT gate.*, CASE WHEN fires >= {MIN_FIRES} THEN lo END AS ev_low, CASE WHEN fires >= {MIN_FIRES} THEN hi END AS ev_high FROM gate JOIN ends ON gate.predicate = ends.predicate AND gate.side = ends.side)"""


def placed_bets(v, when: Column):
    """EV10: a bet at the decision point, by direction, on every window that a predicate hits and that moved."""
    flags = F.array(*(F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(k)) for k, c in enumerate(CONDITIONS)))
    rows = v.filter(when & (F.col("outcome") != "NOISE"))
    sides = F.array(*(F.struct(F.lit(x).alias("side"), (F.col("outcome") == x).alias("win"), entry_price(x)[0].alias("price"), (entry_price(x)[1] == "real").alias("is_real")) for x in ("UP", "DOWN")))
    hits = F.filter(flags, lambda x: x.isNotNull())
    rows = rows.select("series", "start", F.explode(hits).alias("predicate"), sides.alias("sides")).select("series", "start", "predicate", F.inline("sides"))
    return rows.withColumn("pnl", ev.realised(F.col("win"), F.col("price")))


def fires(bets):
    """EV13: what the bets of each predicate and direction give. mean_price holds the noise of its sum: round it to 12 digits before fewer."""
    low = F.avg("pnl") - 1.96 * F.stddev_samp("pnl") / F.sqrt(F.count("*"))
    return bets.groupBy("predicate", "side").agg(F.count("*").alias("fires"), F.count_if("is_real").alias("n_real"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg("price").alias("mean_price"), F.avg("pnl").alias("ev"), low.alias("normal_low"))


def drawn_fires(bets):
    """EV13: fires with the ends of the bootstrap's interval, null below MIN_FIRES bets. A window has one weight for all
    predicates that it fires, and the sums of all replicates of all 588 hypotheses come from one pass over the bets."""
    g = fires(bets)
    keyed = bets.select((F.col("predicate") * 2 + (F.col("side") == "DOWN").cast("int")).alias("hypothesis"), "series", F.floor(F.col("start") / HOUR_MS).alias("hour"), "pnl", F.lit(1).alias("one"))
    ends = ratio_intervals(keyed, "hypothesis", ["series", "hour"], "pnl", "one", DRAWS)
    ends = ends.select(F.floor(F.col("hypothesis") / 2).cast("int").alias("predicate"), F.when(F.col("hypothesis") % 2 == 1, "DOWN").otherwise("UP").alias("side"), "lo", "hi")
    enough = F.col("fires") >= MIN_FIRES
    return g.join(ends, ["predicate", "side"]).select(*g.columns, F.when(enough, F.col("lo")).alias("ev_low"), F.when(enough, F.col("hi")).alias("ev_high"))


_SCREEN_SQL = f"""{views_sql(DECISION_MS)}, {judged_sql(f'start >= {HALF}')}, {_drawn_gate_sql()},
h AS (SELECT predicate, 'UP' AS side, hits, up_hits AS k, base, up_base AS b FROM judged UNION ALL SELECT predicate, 'DOWN', hits, down_hits, base, down_base FROM judged),
t AS (SELECT *, {lift_sql('k', 'hits', 'b', 'base')[0]} AS lift, {lift_sql('k', 'hits', 'b', 'base')[1]} AS se FROM h),
u AS (SELECT *, CASE WHEN hits < {MIN_HITS} THEN NULL WHEN lift > 0 THEN round(1 - {stats.normal_cdf_sql('(ln(lift) / se)')}, 9) ELSE 1.0 END AS p FROM t),
r AS (SELECT *, rank() OVER (ORDER BY p) AS rk, count(*) OVER () AS tests FROM u WHERE p IS NOT NULL),
cut AS (SELECT max(rk) AS k FROM r WHERE p <= rk / tests * {FDR_Q}),
s AS (SELECT u.*, coalesce(r.rk <= (SELECT k FROM cut), false) AS fdr, CASE WHEN u.lift >= {stats.STRONG} THEN CASE WHEN exp(ln(u.lift) - 1.96 * u.se) > 1 THEN 'ACTIVE' ELSE 'REJECT' END WHEN u.lift >= {stats.WEAK} THEN 'OBSERVE' ELSE 'REJECT' END AS track FROM u LEFT JOIN r ON u.predicate = r.predicate AND u.side = r.side),
g AS (SELECT s.*, coalesce(fires, 0) AS fires, coalesce(n_real, 0) AS n_real, ev, coalesce(fires >= {MIN_FIRES} AND ev_low > 0, false) AS pays FROM s LEFT JOIN drawn_gate g ON s.predicate = g.predicate AND s.side = g.side),
screened AS (SELECT *, CASE WHEN hits < {MIN_HITS} THEN 'REJECT' WHEN track = 'ACTIVE' AND fdr AND pays THEN 'ACTIVE' WHEN track IN ('ACTIVE', 'OBSERVE') THEN 'OBSERVE' ELSE 'REJECT' END AS verdict FROM g)"""


def screened(v):
    """DP14, DP15, ST18: both directions of every predicate over the second half."""
    j = judged(v, F.col("start") >= HALF)
    side = lambda x: F.struct(F.lit(x.upper()).alias("side"), F.col(f"{x}_hits").alias("k"), F.col(f"{x}_base").alias("b"))
    h = j.select("predicate", "hits", "base", F.inline(F.array(side("up"), side("down"))))
    h = h.withColumn("l", stats.lift(F.col("k"), F.col("hits"), F.col("b"), F.col("base")))
    tested = F.col("hits") >= MIN_HITS
    p = F.when(tested & (F.col("l.lift") > 0), F.round(1 - stats.normal_cdf(F.ln("l.lift") / F.col("l.log_se")), 9)).when(tested, 1.0)
    h = h.withColumn("p", p)
    # one row for each hypothesis of the catalogue, 588 whatever the data
    tests = h.filter("p IS NOT NULL").withColumns({"rk": F.rank().over(Window.orderBy("p")), "tests": F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    cut = tests.filter(F.col("p") <= F.col("rk") / F.col("tests") * FDR_Q).agg(F.max("rk").alias("cut"))
    passed = tests.join(F.broadcast(cut)).filter(F.col("rk") <= F.col("cut")).select("predicate", "side", F.lit(True).alias("fdr"))
    h = h.join(passed, ["predicate", "side"], "left").join(drawn_fires(placed_bets(v, F.col("start") >= HALF)), ["predicate", "side"], "left")
    h = h.withColumns({"fdr": F.coalesce("fdr", F.lit(False)), "track": stats.verdict(F.col("l.lift"), F.col("l.lo")), "fires": F.coalesce("fires", F.lit(0)), "n_real": F.coalesce("n_real", F.lit(0)), "pays": F.coalesce((F.col("fires") >= MIN_FIRES) & (F.col("ev_low") > 0), F.lit(False))})
    verdict = F.when(~tested, "REJECT").when((F.col("track") == "ACTIVE") & F.col("fdr") & F.col("pays"), "ACTIVE").when(F.col("track").isin("ACTIVE", "OBSERVE"), "OBSERVE").otherwise("REJECT")
    return h.withColumn("verdict", verdict)


@query(
    f"""WITH {_SCREEN_SQL} SELECT predicate, side, hits, k, base, round(lift, 5) AS lift, round(p, 7) AS p, fdr, track, fires, n_real, round(ev, 5) AS ev, pays, verdict,
  CASE WHEN hits < {MIN_HITS} THEN 'insufficient_hits' WHEN verdict = 'REJECT' THEN 'weak_lift' WHEN verdict = 'OBSERVE' AND track = 'ACTIVE' AND NOT fdr THEN 'not_discovered' WHEN verdict = 'OBSERVE' AND track = 'ACTIVE' THEN 'does_not_pay' END AS reason, CASE verdict WHEN 'ACTIVE' THEN 'ACTIVE' WHEN 'OBSERVE' THEN 'EVOLVING' END AS admitted_as FROM screened"""
)
def screened_predicates(spark, d):
    """DP14, DP15, EV10, EV13, ST13, ST14, ST18, WF36: hypotheses on views cut at the decision point: hits, lift over the
    local baseline, one-sided p, step-up discovery, both tracks, whether bets pay (by the lower end of the bootstrap's
    interval, which `gate_intervals` shows), verdict, reason and admission."""
    s = screened(written(views(spark, d, DECISION_MS), "views"))
    active = F.col("track") == "ACTIVE"
    reason = F.when(F.col("hits") < MIN_HITS, "insufficient_hits").when(F.col("verdict") == "REJECT", "weak_lift").when((F.col("verdict") == "OBSERVE") & active & ~F.col("fdr"), "not_discovered").when((F.col("verdict") == "OBSERVE") & active, "does_not_pay")
    admitted = F.when(F.col("verdict") == "ACTIVE", "ACTIVE").when(F.col("verdict") == "OBSERVE", "EVOLVING")
    return s.select("predicate", "side", "hits", "k", "base", F.round("l.lift", 5).alias("lift"), F.round("p", 7).alias("p"), "fdr", "track", "fires", "n_real", F.round("ev", 5).alias("ev"), "pays", "verdict", reason.alias("reason"), admitted.alias("admitted_as"))


@query(
    f"""WITH {views_sql(DECISION_MS)}, {judged_sql(f'start >= {HALF}')}, {_drawn_gate_sql()}
SELECT predicate, side, fires, n_real, round(win_rate, 6) AS win_rate, round(mean_price, 8) AS mean_price, round(ev, 5) AS ev, round(ev_low, 5) AS ev_low, round(ev_high, 5) AS ev_high, round(normal_low, 5) AS normal_low, coalesce(ev_low > 0, false) AS passed FROM drawn_gate"""
)
def gate_intervals(spark, d):
    """EV13: bets, real prices, win rate, mean entry and value of every hypothesis with the bootstrap's 95 % interval beside the
    normal one's lower end, and whether the gate lets it pass."""
    g = drawn_fires(placed_bets(written(views(spark, d, DECISION_MS), "views"), F.col("start") >= HALF))
    return g.select("predicate", "side", "fires", "n_real", r6("win_rate").alias("win_rate"), F.round(F.round("mean_price", 12), 8).alias("mean_price"), *(F.round(c, 5).alias(c) for c in ("ev", "ev_low", "ev_high", "normal_low")), F.coalesce(F.col("ev_low") > 0, F.lit(False)).alias("passed"))


_PATTERNS_SQL = f"pats AS (SELECT predicate, direction, hits AS n, CASE WHEN direction = 'UP' THEN up_hits ELSE down_hits END / hits AS win_rate, 0.5 + least(lift - 1, 0.4) / 2 AS prior FROM hints WHERE lift >= {stats.WEAK})"
RESOLVED_SQL = f"""{_HINTS_SQL}, {_PATTERNS_SQL}, f2 AS (SELECT series, start, outcome, unnest([{', '.join(f'coalesce({c}, false)' for c in CONDITIONS)}]) AS hit, unnest(range({len(CONDITIONS)})) AS predicate FROM views WHERE start >= {HALF}),
hit AS (SELECT f2.*, p.direction, p.n, p.win_rate, p.prior, row_number() OVER (PARTITION BY series, start ORDER BY p.win_rate DESC, p.n DESC, f2.predicate) AS place FROM f2 JOIN pats p ON f2.predicate = p.predicate WHERE hit),
per AS (SELECT series, start, count(*) AS n_hits, count(DISTINCT direction) AS sides, max(predicate) FILTER (place = 1) AS best, max(direction) FILTER (place = 1) AS side, max(n) FILTER (place = 1) AS n, max(win_rate) FILTER (place = 1) AS win_rate, max(prior) FILTER (place = 1) AS prior FROM hit GROUP BY 1, 2),
resolved AS (SELECT v.series, v.start, v.outcome, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits IS NULL THEN 'NONE' WHEN n_hits = 1 THEN 'SINGLE' WHEN sides = 1 THEN 'CONCORDANT' ELSE 'CONFLICT' END AS branch, CASE WHEN sides = 1 THEN CAST(best AS INTEGER) END AS pattern, CASE WHEN sides = 1 THEN side ELSE 'NO_TRADE' END AS direction,
  CASE WHEN sides = 1 THEN n END AS samples, CASE WHEN sides = 1 THEN round(win_rate, 6) END AS win_rate, CASE WHEN sides = 1 THEN round(CASE WHEN n >= {MIN_LIVE} THEN win_rate ELSE prior END, 4) ELSE 0 END AS confidence FROM (SELECT series, start, outcome FROM views WHERE start >= {HALF}) v LEFT JOIN per ON v.series = per.series AND v.start = per.start)"""


def resolved(spark, d):
    """DP17: what the hints of the first half say on each window of the second: none, one, several that agree (the
    strongest speaks), or a conflict, which is not traded."""
    v = written(views(spark, d), "views")
    h = hints(v).filter(F.col("lift") >= stats.WEAK)
    own = F.when(F.col("direction") == "UP", F.col("up_hits")).otherwise(F.col("down_hits"))
    patterns = h.select("predicate", "direction", F.col("hits").alias("n"), (own / F.col("hits")).alias("win_rate"), (0.5 + F.least(F.col("lift") - 1, F.lit(0.4)) / 2).alias("prior"))
    late = v.filter(F.col("start") >= HALF)
    flags = F.array(*(F.coalesce(F.expr(c), F.lit(False)) for c in CONDITIONS))
    hit = late.select("series", "start", F.posexplode(flags).alias("predicate", "hit")).filter("hit").join(F.broadcast(patterns), "predicate")  # at most 294 rows
    first = F.struct((-F.col("win_rate")).alias("a"), (-F.col("n")).alias("b"), F.col("predicate").alias("c"))
    per = hit.groupBy("series", "start").agg(F.count("*").alias("k"), F.countDistinct(F.upper("direction")).alias("sides"), F.min_by(F.struct("predicate", "direction", "n", "win_rate", "prior"), first).alias("best"))
    one = F.col("sides") == 1
    branch = F.when(F.col("k").isNull(), "NONE").when(F.col("k") == 1, "SINGLE").when(one, "CONCORDANT").otherwise("CONFLICT")
    confidence = F.when(one, F.round(F.when(F.col("best.n") >= MIN_LIVE, F.col("best.win_rate")).otherwise(F.col("best.prior")), 4)).otherwise(0.0)
    return late.select("series", "start", "outcome").join(per, ["series", "start"], "left").select(
        "series", "start", "outcome", F.coalesce("k", F.lit(0)).alias("n_hits"), branch.alias("branch"), F.when(one, F.col("best.predicate")).alias("pattern"), F.when(one, F.col("best.direction")).otherwise("NO_TRADE").alias("direction"),
        F.when(one, F.col("best.n")).alias("samples"), F.when(one, r6("best.win_rate")).alias("win_rate"), confidence.alias("confidence"),
    )


@query(f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def resolved_hits(spark, d):
    """WF29, AF37, DP17, PF9: strongest hit, agreement or conflict of patterns mined before, live confidence or prior."""
    return resolved(spark, d)


# The nine rules of the trade gate in their order, each with the reason that it gives when it fails.
_GATE = (
    ("switched_off", "series % 7 = 6"), ("alert_blocked", "day_losses >= 4"), ("no_direction", "direction NOT IN ('UP', 'DOWN')"), ("low_confidence", "confidence <= 0.6"), ("few_samples", "samples IS NOT NULL AND samples < 5"),
    ("low_win_rate", "win_rate IS NOT NULL AND win_rate < 0.4"), ("losing_streak", "streak >= 5"), ("daily_trades", "day_trades >= 20"), ("daily_loss", "day_pnl <= -10"),
)
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in _GATE) + " ELSE 'ok' END"
_WON = "CASE WHEN direction IN ('UP', 'DOWN') AND outcome <> 'NOISE' THEN direction = outcome END"


@query(
    f"""WITH {RESOLVED_SQL}, o AS (SELECT *, start // 86400000 AS day, {_WON} AS won, row_number() OVER (PARTITION BY series ORDER BY start) AS i FROM resolved),
p AS (SELECT *, count(won) OVER e AS day_trades, coalesce(sum(CASE WHEN won THEN 0.96 ELSE -1 END) FILTER (won IS NOT NULL) OVER e, 0) AS day_pnl, count(*) FILTER (NOT won) OVER e AS day_losses, coalesce(max(CASE WHEN won THEN i END) OVER b, 0) AS last_win FROM o
  WINDOW e AS (PARTITION BY series, day ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, count(*) FILTER (NOT won) OVER (PARTITION BY series, last_win ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS streak FROM p)
SELECT series, start, direction, confidence, day_trades, round(day_pnl, 6) AS day_pnl, day_losses, streak, CASE WHEN branch = 'CONFLICT' THEN 'conflict' ELSE {_REASON} END AS reason, branch <> 'CONFLICT' AND {_REASON} = 'ok' AS traded FROM s"""
)
def trade_gate(spark, d):
    """PF13, PF14, DP35, WF30, AG9: nine rules in their order over each prediction and what was settled before it; the first
    that fails gives the reason, and one set beforehand (a conflict) wins."""
    w = Window.partitionBy("series").orderBy("start")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    of_day = Window.partitionBy("series", "day").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    o = resolved(spark, d).withColumns({"day": F.floor(F.col("start") / 86_400_000), "won": F.expr(_WON), "i": F.row_number().over(w)})
    gain = F.when(F.col("won").isNotNull(), F.when(F.col("won"), 0.96).otherwise(-1.0))
    o = o.withColumns({"day_trades": F.count("won").over(of_day), "day_pnl": F.coalesce(F.sum(gain).over(of_day), F.lit(0.0)), "day_losses": F.count_if(~F.col("won")).over(of_day), "last_win": F.coalesce(F.max(F.when(F.col("won"), F.col("i"))).over(past), F.lit(0))})
    o = o.withColumn("streak", F.count_if(~F.col("won")).over(Window.partitionBy("series", "last_win").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
    preset = F.when(F.col("branch") == "CONFLICT", "conflict")
    o = o.withColumn("reason", F.coalesce(preset, F.expr(_REASON)))
    return o.select("series", "start", "direction", "confidence", "day_trades", r6("day_pnl").alias("day_pnl"), "day_losses", "streak", "reason", (F.col("reason") == "ok").alias("traded"))


@query(
    f"""WITH {views_sql(WHOLE_MS)}, {judged_sql('true')}, {_fires_sql()}, full_gate AS (SELECT * FROM gate)
SELECT predicate, side, 'whole' AS views, fires, round(win_rate, 6) AS win_rate, round(mean_price, 8) AS mean_price, round(ev, 5) AS ev FROM full_gate
UNION ALL SELECT * FROM (WITH {views_sql(DECISION_MS)}, {judged_sql('true')}, {_fires_sql()} SELECT predicate, side, 'cut', fires, round(win_rate, 6), round(mean_price, 8), round(ev, 5) FROM gate)"""
)
def predicate_bench(spark, d):
    """DP29, TB9: what betting on each predicate's hits gives on whole windows (which see the future) and on those cut at the decision point."""
    def bench(until: int, name: str):
        g = fires(placed_bets(views(spark, d, until), F.lit(True)))
        return g.select("predicate", "side", F.lit(name).alias("views"), "fires", r6("win_rate").alias("win_rate"), F.round(F.round("mean_price", 12), 8).alias("mean_price"), F.round("ev", 5).alias("ev"))

    return bench(WHOLE_MS, "whole").unionByName(bench(DECISION_MS, "cut"))
