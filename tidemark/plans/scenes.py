"""Queries of scenes: patterns at a cycle's close, derived signals, captured quotes, settlement, decision tables and surfaces."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.functions import ev, stats
from tidemark.operators.neighbours import most_similar, voted
from tidemark.operators.shared import written
from tidemark.plans import detection
from tidemark.plans.hypotheses import FEATURES_SQL, HYPOTHESES, features
from tidemark.plans.lifecycle import _TILES_SQL, HALF, tiles
from tidemark.plans.market import r6
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, HOUR_MS

CYCLE_MS = 3 * HOUR_MS
# Seconds of five minutes are twelve of the clock's here: delay and latest moment of an entry quote, of the later one.
ENTRY_MS, LATEST_MS, LATER_MS = 96_000, 1_080_000, 3_600_000
#: Spark's text of a week's Monday in both engines.
_WEEK = "strftime(make_timestamp((signal_ts - ((signal_ts // 86400000 + 3) % 7) * 86400000) // 86400000 * 86400000 * 1000), '%Y-%m-%d')"

_SCENES_SQL = f"""b AS ({ORACLE_SQL["break_events"]}), k AS ({ORACLE_SQL["candle_patterns"]}), {BARS_SQL},
due AS (SELECT series, cycle_ts, side FROM b),
cl AS (SELECT k.series, CAST(floor(k.bar_ts / 10800000) * 10800000 AS BIGINT) AS cycle_ts, arg_max({{'p': close_pos, 'x': three}}, k.bar_ts).p AS close_pos, arg_max({{'p': close_pos, 'x': three}}, k.bar_ts).x AS three FROM k JOIN (SELECT series, bar_ts, sign(c - o) > 0 AND lag(sign(c - o)) OVER w > 0 AS three FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)) t ON k.series = t.series AND k.bar_ts = t.bar_ts GROUP BY 1, 2),
sides AS (SELECT cl.*, h.side IS NOT NULL AS high, l.side IS NOT NULL AS low FROM cl LEFT JOIN due h ON h.series = cl.series AND h.cycle_ts = cl.cycle_ts AND h.side = 'high' LEFT JOIN due l ON l.series = cl.series AND l.cycle_ts = cl.cycle_ts AND l.side = 'low'),
fired AS (SELECT series, cycle_ts, 'bull_exhaust' AS pattern, 'DOWN' AS direction FROM sides WHERE high AND close_pos >= 0.5 UNION ALL SELECT series, cycle_ts, 'bear_exhaust', 'UP' FROM sides WHERE low AND close_pos <= 0.5
  UNION ALL SELECT series, cycle_ts, 'momentum_fade', 'DOWN' FROM sides WHERE NOT high AND three AND close_pos >= 0.5)"""


def scenes(spark, d):
    """Signals at the close of each cycle: exhaustion on each side that broke, fading momentum only where no high broke."""
    due = detection.break_events(spark, d).select("series", "cycle_ts", "side").groupBy("series", "cycle_ts").agg(F.max(F.col("side") == "high").alias("high"), F.max(F.col("side") == "low").alias("low"))
    w = src.by_time()
    rising = F.signum(F.col("c") - F.col("o")) > 0
    b = src.bars(spark, d).withColumn("three", rising & F.lag(rising).over(w)).select("series", "bar_ts", "three")
    k = detection.candle_patterns(spark, d).select("series", "bar_ts", "close_pos").join(b, ["series", "bar_ts"]).withColumn("cycle_ts", src.bucket(F.col("bar_ts"), CYCLE_MS))
    at = k.groupBy("series", "cycle_ts").agg(F.max_by(F.struct("close_pos", "three"), "bar_ts").alias("x")).select("series", "cycle_ts", "x.*")
    s = at.join(due, ["series", "cycle_ts"], "left").fillna(False, ["high", "low"])
    top, bottom = F.col("close_pos") >= 0.5, F.col("close_pos") <= 0.5
    cases = (("bull_exhaust", "DOWN", F.col("high") & top), ("bear_exhaust", "UP", F.col("low") & bottom), ("momentum_fade", "DOWN", ~F.col("high") & F.col("three") & top))
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("pattern"), F.lit(x).alias("direction"), c.alias("on")) for n, x, c in cases)), lambda z: z["on"])
    return s.select("series", "cycle_ts", F.inline(found)).drop("on")


@query(
    f"""WITH {_SCENES_SQL}, n AS (SELECT f.*, f.cycle_ts + {CYCLE_MS} AS signal_ts FROM fired f),
a AS (SELECT n.*, x.o AS anchor, x.c AS c5, l.c AS close15, lo.o AS own_open FROM n LEFT JOIN bars x ON x.series = n.series AND x.bar_ts = n.signal_ts LEFT JOIN bars l ON l.series = n.series AND l.bar_ts = n.signal_ts + 7200000 LEFT JOIN bars lo ON lo.series = n.series AND lo.bar_ts = n.signal_ts + 3600000),
q AS (SELECT a.series, a.cycle_ts, a.pattern, arg_min(s.q, (s.t, s.event_id)) FILTER (s.t - a.signal_ts BETWEEN {ENTRY_MS} AND {LATEST_MS}) AS entry_q, arg_min(s.q, (s.t, s.event_id)) FILTER (s.t - a.signal_ts >= {LATER_MS}) AS later_q FROM a JOIN samples s ON s.series = a.series AND s.t >= a.signal_ts AND s.t < a.signal_ts + {CYCLE_MS} GROUP BY 1, 2, 3),
z AS (SELECT a.*, entry_q, later_q, coalesce(anchor, own_open) AS base, CASE WHEN anchor IS NULL OR anchor <= 0 OR c5 <= 0 THEN 'INVALID' WHEN c5 < anchor THEN 'CONFIRM' WHEN c5 > anchor THEN 'RISING' ELSE 'FLAT' END AS confirm FROM a LEFT JOIN q ON q.series = a.series AND q.cycle_ts = a.cycle_ts AND q.pattern = a.pattern),
y AS (SELECT *, CASE WHEN base IS NULL OR close15 IS NULL THEN 'EXPIRED' WHEN close15 < base THEN 'DOWN' WHEN close15 > base THEN 'UP' ELSE 'NOISE' END AS settled FROM z)
SELECT series, cycle_ts, pattern, direction, round(entry_q, 6) AS entry_q, round(later_q, 6) AS later_q, CASE WHEN pattern = 'bull_exhaust' THEN confirm END AS derived, pattern = 'bull_exhaust' AND confirm = 'CONFIRM' AS derived_fires, settled, CASE WHEN settled IN ('UP', 'DOWN') THEN settled = direction END AS win,
  CASE WHEN settled IN ('UP', 'DOWN') THEN round(CASE WHEN settled = direction THEN 0.98 / coalesce(CASE WHEN direction = 'UP' THEN entry_q ELSE 1 - entry_q END, 0.51) - 1 ELSE -1 END, 6) END AS pnl FROM y"""
)
def settled_scenes(spark, d):
    """DP6, DP7, DP8, DP9, AF31, EV5: scenes with the first quotes after their delays, the confirmation by the next cycle's first
    bar and the signal it derives, and settlement of close against the cycle's opening (the bar after it where it is missing)."""
    s = scenes(spark, d).withColumn("signal_ts", F.col("cycle_ts") + CYCLE_MS)
    b = src.bars(spark, d).withColumn("cycle_ts", src.bucket(F.col("bar_ts"), CYCLE_MS) - CYCLE_MS).withColumn("k", (F.col("bar_ts") - F.col("cycle_ts") - CYCLE_MS) / HOUR_MS)
    of = lambda k, x: F.max(F.when(F.col("k") == k, F.col(x)))
    after = b.groupBy("series", "cycle_ts").agg(of(0, "o").alias("anchor"), of(0, "c").alias("c5"), of(1, "o").alias("own_open"), of(2, "c").alias("close15"))
    x = src.samples(spark, d).withColumn("cycle_ts", src.bucket(F.col("t"), CYCLE_MS) - CYCLE_MS).withColumn("off", F.col("t") - F.col("cycle_ts") - CYCLE_MS)
    at = F.struct("t", "event_id")
    first = lambda c: F.min_by(F.when(c, F.col("q")), F.when(c, at))
    quotes = x.groupBy("series", "cycle_ts").agg(first(F.col("off").between(ENTRY_MS, LATEST_MS)).alias("entry_q"), first(F.col("off") >= LATER_MS).alias("later_q"))
    z = s.join(after, ["series", "cycle_ts"], "left").join(quotes, ["series", "cycle_ts"], "left").withColumn("base", F.coalesce("anchor", "own_open"))
    confirm = F.when(F.col("anchor").isNull() | (F.col("anchor") <= 0) | (F.col("c5") <= 0), "INVALID").when(F.col("c5") < F.col("anchor"), "CONFIRM").when(F.col("c5") > F.col("anchor"), "RISING").otherwise("FLAT")
    settled = F.when(F.col("base").isNull() | F.col("close15").isNull(), "EXPIRED").when(F.col("close15") < F.col("base"), "DOWN").when(F.col("close15") > F.col("base"), "UP").otherwise("NOISE")
    bull = F.col("pattern") == "bull_exhaust"
    z = z.withColumns({"derived": F.when(bull, confirm), "settled": settled})
    win = F.when(F.col("settled").isin("UP", "DOWN"), F.col("settled") == F.col("direction"))
    entry = F.when(F.col("direction") == "UP", F.col("entry_q")).otherwise(1 - F.col("entry_q"))
    return z.select("series", "cycle_ts", "pattern", "direction", r6("entry_q").alias("entry_q"), r6("later_q").alias("later_q"), "derived", (bull & (F.col("derived") == "CONFIRM")).alias("derived_fires"), "settled", win.alias("win"), F.when(win.isNotNull(), r6(ev.realised_or_fallback(win, entry))).alias("pnl"))


@query(
    f"""WITH s AS ({ORACLE_SQL["settled_scenes"]}), w AS (SELECT *, cycle_ts + {CYCLE_MS} AS signal_ts FROM s WHERE win IS NOT NULL)
SELECT pattern, {_WEEK} AS week, count(*) AS n, count(*) FILTER (win) AS wins, round(avg(CASE WHEN win THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(pnl), 6) AS pnl, round(count(*) FILTER (NOT win) / count(*), 6) AS loss_rate FROM w GROUP BY 1, 2"""
)
def scene_weeks(spark, d):
    """DP10: settled scenes of each pattern by the Monday of their week."""
    s = settled_scenes(spark, d).filter("win IS NOT NULL")
    week = F.date_format(F.date_trunc("week", F.timestamp_millis(F.col("cycle_ts") + CYCLE_MS)), "yyyy-MM-dd")
    return s.groupBy("pattern", week.alias("week")).agg(F.count("*").alias("n"), F.count_if("win").alias("wins"), r6(F.avg(F.col("win").cast("double"))).alias("win_rate"), r6(F.sum("pnl")).alias("pnl"), r6(F.count_if(~F.col("win")) / F.count("*")).alias("loss_rate"))


@query(
    f"""WITH s AS ({ORACLE_SQL["shadow_signals"]}), {BARS_SQL}, j AS (SELECT s.series, s.window_start, s.window_start + 3600000 AS target, b.outcome, b.o, b.ret FROM s LEFT JOIN bars b ON b.series = s.series AND b.bar_ts = s.window_start + 3600000)
SELECT series, window_start, target, CASE WHEN outcome IS NULL THEN 'OPEN' WHEN ret = 0 THEN 'VOID' ELSE 'SETTLED' END AS status, CASE WHEN ret <> 0 THEN outcome = 'DOWN' END AS win, round(CASE WHEN ret <> 0 THEN CASE WHEN outcome = 'DOWN' THEN 0.98 / least(greatest(1 - o + 0.01, 0.01), 0.99) - 1 ELSE -1 END END, 6) AS pnl FROM j"""
)
def settled_targets(spark, d):
    """JN10, PF2: signals joined with the window they aim at, by its start; one that did not move settles nothing."""
    s = detection.shadow_signals(spark, d).select("series", "window_start", (F.col("window_start") + HOUR_MS).alias("target"))
    b = src.bars(spark, d).select("series", F.col("bar_ts").alias("target"), "outcome", "o", "ret")
    j = s.join(b, ["series", "target"], "left")
    win = F.when(F.col("ret") != 0, F.col("outcome") == "DOWN")
    status = F.when(F.col("outcome").isNull(), "OPEN").when(F.col("ret") == 0, "VOID").otherwise("SETTLED")
    return j.select("series", "window_start", "target", status.alias("status"), win.alias("win"), r6(ev.realised(win, 1 - F.col("o"))).alias("pnl"))


@query(
    f"""WITH {BARS_SQL}, c AS (SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS bar_ts, event_id, q, t FROM samples WHERE event_type = 'click'),
r AS (SELECT c.*, b.o FROM c JOIN bars b ON b.series = c.series AND b.bar_ts = c.bar_ts), g AS (SELECT *, (q - o) / o * 100 AS chg FROM r)
SELECT event_id, round(chg, 6) AS chg_pct, CASE WHEN o > 0 THEN chg <= -0.10 END AS falls, CASE WHEN o > 0 THEN chg < 0.10 END AS does_not_rise FROM g"""
)
def price_guards(spark, d):
    """AF32: both price guards at each click: has fallen by 0.1 %, has not risen by it."""
    c = src.samples(spark, d).filter("event_type = 'click'").withColumn("bar_ts", src.bucket(F.col("t"), HOUR_MS))
    j = c.join(src.bars(spark, d).select("series", "bar_ts", "o"), ["series", "bar_ts"])
    chg = (F.col("q") - F.col("o")) / F.col("o") * 100
    known = F.col("o") > 0
    return j.select("event_id", r6(chg).alias("chg_pct"), F.when(known, chg <= -0.10).alias("falls"), F.when(known, chg < 0.10).alias("does_not_rise"))


@query(
    f"""WITH {_TILES_SQL}, x AS (SELECT *, least(5, CAST(floor((1 - frac) * 6) AS INTEGER)) AS tau_bin, CASE WHEN z < -2 THEN 0 WHEN z < -0.5 THEN 1 WHEN z < 0.5 THEN 2 WHEN z < 2 THEN 3 ELSE 4 END AS d_bin FROM (SELECT zs.*, (s.t - zs.bar_ts) / 3600000.0::DOUBLE AS frac FROM zs JOIN samples s USING (event_id)))
SELECT tau_bin, d_bin, count(*) AS n, round(median(round(down, 6)), 6) AS price, round(count(*) FILTER (outcome = 'DOWN') / nullif(count(*) FILTER (outcome <> 'NOISE'), 0), 6) AS freq FROM x GROUP BY 1, 2 HAVING count(*) >= 20"""
)
def distance_surface(spark, d):
    """AG36: price and frequency by six parts of the time left and five of the distance from the open, with 20 rows or more."""
    t = tiles(spark, d).join(src.samples(spark, d).select("event_id", "t"), "event_id")
    left = 1 - (F.col("t") - F.col("bar_ts")) / HOUR_MS
    z = F.col("z")
    t = t.withColumns({"tau_bin": F.least(F.lit(5), F.floor(left * 6).cast("int")), "d_bin": F.when(z < -2, 0).when(z < -0.5, 1).when(z < 0.5, 2).when(z < 2, 3).otherwise(4), "p": F.round("down", 6)})
    values = t.groupBy("tau_bin", "d_bin", "p").agg(F.count("*").alias("k"), F.count_if(F.col("outcome") == "DOWN").alias("fell"), F.count_if(F.col("outcome") != "NOISE").alias("moved"))
    g = values.groupBy("tau_bin", "d_bin").agg(F.sum("k").alias("n"), r6(F.percentile("p", 0.5, F.col("k"))).alias("price"), r6(F.sum("fell") / F.nullif(F.sum("moved"), F.lit(0))).alias("freq"))
    return g.filter("n >= 20")


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT s.series, s.t, s.event_id, s.q, s.volume, b.o, b.outcome, CAST((s.t - b.bar_ts) // 300000 AS INTEGER) AS minute, b.bar_ts FROM samples s JOIN bars b ON b.series = s.series AND b.bar_ts = CAST(floor(s.t / 3600000) * 3600000 AS BIGINT)),
f AS (SELECT *, row_number() OVER (PARTITION BY series, bar_ts, minute ORDER BY t, event_id) AS rn FROM x),
g AS (SELECT minute, CASE WHEN q > o THEN 'up' WHEN q < o THEN 'down' ELSE 'even' END AS state, CASE WHEN volume < 20 THEN 'thin' WHEN volume < 60 THEN 'mid' ELSE 'deep' END AS depth, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (outcome = 'UP') AS DOUBLE) AS k, avg(q) AS mean_q, sum(q * volume) / nullif(sum(volume), 0) AS blended FROM f WHERE rn = 1 AND outcome <> 'NOISE' GROUP BY 1, 2, 3)
SELECT minute, state, depth, CAST(n AS BIGINT) AS n, round(k / n, 6) AS win_rate, round(mean_q, 12) AS mean_q, round(blended, 12) AS blended_q, round(k / n - mean_q, 12) AS dev, round(k / n * (0.98 / (mean_q + 0.01) - 1) - (1 - k / n), 10) AS ev,
  CASE WHEN n >= 50 THEN round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) END AS wilson_lo FROM g"""
)
def decision_table(spark, d):
    """AG24, AG26, TB7: by five minutes of the window, state against its open and depth: rate, quotes (plain and weighted by
    depth), deviation and value, with the lower bound from 50 rows."""
    s = src.samples(spark, d).withColumn("bar_ts", src.bucket(F.col("t"), HOUR_MS)).withColumn("minute", F.floor((F.col("t") - F.col("bar_ts")) / 300_000).cast("int"))
    first = s.groupBy("series", "bar_ts", "minute").agg(F.min_by(F.struct("q", "volume"), F.struct("t", "event_id")).alias("x")).select("series", "bar_ts", "minute", "x.*")
    j = first.join(src.bars(spark, d).select("series", "bar_ts", "o", "outcome"), ["series", "bar_ts"]).filter("outcome <> 'NOISE'")
    state = F.when(F.col("q") > F.col("o"), "up").when(F.col("q") < F.col("o"), "down").otherwise("even")
    depth = F.when(F.col("volume") < 20, "thin").when(F.col("volume") < 60, "mid").otherwise("deep")
    g = j.groupBy("minute", state.alias("state"), depth.alias("depth")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "UP").alias("k"), F.avg("q").alias("mean_q"), (F.sum(F.col("q") * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("blended"))
    p = F.col("k") / F.col("n")
    return g.select("minute", "state", "depth", "n", r6(p).alias("win_rate"), F.round("mean_q", 12).alias("mean_q"), F.round("blended", 12).alias("blended_q"), F.round(p - F.col("mean_q"), 12).alias("dev"), F.round(ev.expected(p, F.col("mean_q")), 10).alias("ev"), F.when(F.col("n") >= 50, r6(stats.wilson_lower(F.col("k"), F.col("n")))).alias("wilson_lo"))


_TIMES = (15, 30, 45)


# Numbers of a curve up to the decision: both engines read the text.
CURVE = ("min_by(q, struct(t, event_id))", "max_by(q, struct(t, event_id))", "max(q)", "min(q)", "avg(q)", "CAST(count(*) AS DOUBLE)")
NEIGHBOURS = 3
_CURVE_SQL = ", ".join(e.replace("min_by", "arg_min").replace("max_by", "arg_max").replace("struct(t, event_id)", "(t, event_id)") for e in CURVE)


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT unnest({list(_TIMES)}) AS minute), w AS (SELECT series, bar_ts, outcome, o FROM bars),
c AS (SELECT s.series, w.bar_ts, m.minute, [{_CURVE_SQL}] AS v FROM samples s JOIN w ON w.series = s.series AND w.bar_ts = CAST(floor(s.t / 3600000) * 3600000 AS BIGINT), m WHERE s.t - w.bar_ts <= m.minute * 60000 GROUP BY 1, 2, 3),
e AS (SELECT series, bar_ts, minute, unnest(v) AS x, unnest(range(len(v))) AS i FROM c), sc AS (SELECT minute, i, avg(x) AS mu, stddev_pop(x) AS sd FROM e WHERE bar_ts < {HALF} GROUP BY 1, 2),
z AS (SELECT series, bar_ts, minute, list((x - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END ORDER BY i) AS z FROM e JOIN sc USING (minute, i) GROUP BY 1, 2, 3), u AS (SELECT *, series * 1048576 + bar_ts // 3600000 AS id, sqrt(list_dot_product(z, z)) AS norm FROM z),
n AS (SELECT q.minute, q.id, d.id AS other, row_number() OVER (PARTITION BY q.minute, q.id ORDER BY round(list_dot_product(q.z, d.z) / (q.norm * d.norm), 6) DESC, d.id) AS rn FROM u q JOIN u d ON q.minute = d.minute AND q.bar_ts >= {HALF} AND d.bar_ts < {HALF} AND q.norm > 0 AND d.norm > 0),
vt AS (SELECT minute, n.id, outcome, count(*) AS votes FROM n JOIN (SELECT series * 1048576 + bar_ts // 3600000 AS other, outcome FROM w) l USING (other) WHERE rn <= {NEIGHBOURS} AND outcome <> 'NOISE' GROUP BY 1, 2, 3), pl AS (SELECT *, rank() OVER (PARTITION BY minute, id ORDER BY votes DESC) AS place FROM vt),
k AS (SELECT minute, id, CASE WHEN count(*) FILTER (place = 1) = 1 THEN max(outcome) FILTER (place = 1) END AS voted FROM pl GROUP BY 1, 2),
x AS (SELECT w.series, w.bar_ts, w.outcome, w.o, m.minute, c.v[2] AS q, k.voted FROM w JOIN m ON true LEFT JOIN c ON c.series = w.series AND c.bar_ts = w.bar_ts AND c.minute = m.minute LEFT JOIN k ON k.minute = m.minute AND k.id = w.series * 1048576 + w.bar_ts // 3600000 WHERE w.outcome <> 'NOISE' AND w.bar_ts >= {HALF}),
y AS (SELECT minute, 'naive' AS strategy, q, outcome, CASE WHEN q > 0.5 THEN 'UP' WHEN q < 0.5 THEN 'DOWN' END AS bet FROM x UNION ALL SELECT minute, 'fade', q, outcome, CASE WHEN q > 0.5 THEN 'DOWN' WHEN q < 0.5 THEN 'UP' END FROM x UNION ALL SELECT minute, 'trend', q, outcome, CASE WHEN q > o * 1.2 THEN 'UP' WHEN q < o * 0.8 THEN 'DOWN' END FROM x UNION ALL SELECT minute, 'neighbours', q, outcome, voted FROM x),
v AS (SELECT *, bet = outcome AS win, CASE WHEN bet = 'UP' THEN q ELSE 1 - q END AS price FROM y)
SELECT minute, strategy, count(*) AS windows, count(q) AS quoted, count(bet) AS bets, round(avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) FILTER (bet IS NOT NULL), 6) AS win_rate, round(avg(CASE WHEN win THEN 0.98 / least(greatest(price + 0.01, 0.01), 0.99) - 1 ELSE -1 END) FILTER (bet IS NOT NULL), 5) AS ev FROM v GROUP BY 1, 2"""
)
def strategies(spark, d):
    """EV17, JN15: following the quote, fading it, following a large move and the vote of the nearest curves at three times over the
    windows of the second half, each of which can abstain. Curves up to the decision are standardised by the first half, of
    which the most similar by cosine vote; a join that prunes by pivots finds them."""
    s = src.samples(spark, d).withColumn("bar_ts", src.bucket(F.col("t"), HOUR_MS))
    s = s.withColumn("minute", F.explode(F.array(*map(F.lit, _TIMES)))).filter(F.col("t") - F.col("bar_ts") <= F.col("minute") * 60_000)
    key = (F.col("series") * 1_048_576 + F.floor(F.col("bar_ts") / HOUR_MS)).alias("id")
    c = written(s.groupBy("series", "bar_ts", "minute").agg(F.array(*(F.expr(e).cast("double") for e in CURVE)).alias("v")).select("series", "bar_ts", "minute", key, "v"), "curves")
    w = src.bars(spark, d).select("series", "bar_ts", "outcome", "o")
    early = F.col("bar_ts") < HALF
    labels = w.filter(early & (F.col("outcome") != "NOISE")).select(key.alias("other"), F.col("outcome").alias("label"))
    votes = []
    for m in _TIMES:
        at = c.filter(F.col("minute") == m)
        scale = at.filter(early).agg(*(F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(len(CURVE))), *(F.stddev_pop(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(CURVE)))).first()
        z = F.array(*((F.get("v", F.lit(i)) - F.lit(scale[f"m{i}"])) / F.lit(scale[f"s{i}"] if (scale[f"s{i}"] or 0) > 1e-12 else 1.0) for i in range(len(CURVE))))
        rows = at.select("bar_ts", "id", z.alias("v"))
        found = most_similar(rows.filter(~early), rows.filter(early), NEIGHBOURS, len(CURVE))
        votes.append(voted(found, labels).select(F.lit(m).alias("minute"), "id", "voted"))
    k = votes[0].unionByName(votes[1]).unionByName(votes[2])
    x = w.filter((F.col("outcome") != "NOISE") & ~early).select("*", key, F.explode(F.array(*map(F.lit, _TIMES))).alias("minute"))
    x = x.join(c.select("id", "minute", F.get("v", F.lit(1)).alias("q")), ["id", "minute"], "left").join(k, ["id", "minute"], "left")
    q, o = F.col("q"), F.col("o")
    bets = {"naive": F.when(q > 0.5, "UP").when(q < 0.5, "DOWN"), "fade": F.when(q > 0.5, "DOWN").when(q < 0.5, "UP"), "trend": F.when(q > o * 1.2, "UP").when(q < o * 0.8, "DOWN"), "neighbours": F.col("voted")}
    v = x.select("minute", "q", "outcome", F.inline(F.array(*(F.struct(F.lit(k).alias("strategy"), b.alias("bet")) for k, b in bets.items()))))
    win = F.col("bet") == F.col("outcome")
    price = F.when(F.col("bet") == "UP", F.col("q")).otherwise(1 - F.col("q"))
    return v.groupBy("minute", "strategy").agg(F.count("*").alias("windows"), F.count("q").alias("quoted"), F.count("bet").alias("bets"), r6(F.avg(win.cast("double"))).alias("win_rate"), F.round(F.avg(ev.realised(win, price)), 5).alias("ev"))


_VARIANTS = [(offset, broke, reclaim) for offset in (0, 1) for broke in (0.0005, 0.01) for reclaim in (0.0, 0.05)]


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, max(c) OVER p AS hi, count(*) OVER p AS k, lead(c, 1) OVER w AS c1, lead(bar_ts, 1) OVER w AS t1, lead(c, 2) OVER w AS c2, lead(bar_ts, 2) OVER w AS t2 FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts), p AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
v(off_bars, broke, reclaim) AS (VALUES {', '.join(f'({a}, {b}, {c})' for a, b, c in _VARIANTS)}), y AS (SELECT v.*, CASE WHEN off_bars = 0 THEN c ELSE c1 END AS entry, CASE WHEN off_bars = 0 THEN c1 ELSE c2 END AS final, CASE WHEN off_bars = 0 THEN t1 ELSE t2 END - bar_ts AS wait, hi FROM x, v WHERE k = 24 AND h > hi * (1 + broke) AND c < hi * (1 - reclaim))
SELECT off_bars, CAST(broke AS DOUBLE) AS broke, CAST(reclaim AS DOUBLE) AS reclaim, count(*) AS n, round(avg(CASE WHEN final < entry THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(CASE WHEN final < entry THEN 0.98 / least(greatest(1 - entry + 0.01, 0.01), 0.99) - 1 ELSE -1 END), 5) AS ev FROM y WHERE wait = 3600000 * (off_bars + 1) AND final <> entry GROUP BY 1, 2, 3"""
)
def break_variants(spark, d):
    """DP28: false breaks of a level under each combination of entry offset, size of the break and reclaim, with the value of fading them."""
    w, p = src.by_time(), src.by_time().rowsBetween(-24, -1)
    x = src.bars(spark, d).withColumns({"hi": F.max("c").over(p), "k": F.count("*").over(p)} | {f"c{i}": F.lead("c", i).over(w) for i in (1, 2)} | {f"t{i}": F.lead("bar_ts", i).over(w) for i in (1, 2)}).filter("k = 24")
    cases = F.array(*(F.struct(F.lit(a).alias("off_bars"), F.lit(float(b)).alias("broke"), F.lit(float(c)).alias("reclaim")) for a, b, c in _VARIANTS))
    y = x.select("*", F.inline(cases)).filter((F.col("h") > F.col("hi") * (1 + F.col("broke"))) & (F.col("c") < F.col("hi") * (1 - F.col("reclaim"))))
    now = F.col("off_bars") == 0
    y = y.withColumns({"entry": F.when(now, F.col("c")).otherwise(F.col("c1")), "final": F.when(now, F.col("c1")).otherwise(F.col("c2")), "wait": F.when(now, F.col("t1")).otherwise(F.col("t2")) - F.col("bar_ts")})
    y = y.filter((F.col("wait") == HOUR_MS * (F.col("off_bars") + 1)) & (F.col("final") != F.col("entry")))
    win = F.col("final") < F.col("entry")
    return y.groupBy("off_bars", "broke", "reclaim").agg(F.count("*").alias("n"), r6(F.avg(win.cast("double"))).alias("win_rate"), F.round(F.avg(ev.realised(win, 1 - F.col("entry"))), 5).alias("ev"))


# Hypotheses by the direction that they expect, which pairs and triples must share.
_EXPECTED = {"fell": "UP", "closed_at_low": "UP", "range_bottom": "UP", "broke_low": "UP", "rose": "DOWN", "closed_at_high": "DOWN", "range_top": "DOWN", "broke_high": "DOWN"}
_COMBOS = [names for side in ("UP", "DOWN") for k in (1, 2, 3) for names in itertools.combinations([n for n, s in _EXPECTED.items() if s == side], k)]


def _combo(names) -> str:
    return " AND ".join(f"({HYPOTHESES[n]})" for n in names)


@query(
    f"WITH {FEATURES_SQL}, c AS ("
    + " UNION ALL ".join(f"SELECT '{' & '.join(n)}' AS combination, {len(n)} AS size, count(*) FILTER (({_combo(n)}) AND cycle_ts < {HALF}) AS n_disc, count(*) FILTER (({_combo(n)}) AND cycle_ts < {HALF} AND next_d {'>' if _EXPECTED[n[0]] == 'UP' else '<'} 0) AS k_disc, count(*) FILTER (({_combo(n)}) AND cycle_ts >= {HALF}) AS n_val, count(*) FILTER (({_combo(n)}) AND cycle_ts >= {HALF} AND next_d {'>' if _EXPECTED[n[0]] == 'UP' else '<'} 0) AS k_val FROM feats" for n in _COMBOS)
    + f""") SELECT combination, CAST(size AS INTEGER) AS size, n_disc, k_disc, n_val, k_val, CASE WHEN n_disc > 0 THEN round(least(1.0, 2 * {stats.normal_cdf_sql("(-greatest((abs(k_disc - n_disc * 0.5) - 0.5) / sqrt(n_disc * 0.25), 0))")}), 7) END AS p, n_disc >= 5 AND k_disc > 0.5 * n_disc AND n_val >= 5 AND k_val > 0.5 * n_val AS survives FROM c"""
)
def hypothesis_combinations(spark, d):
    """JN19, DP21, AG32, UD3: hypotheses, pairs and triples of one expected direction, counted in one pass over both halves: p on
    the first, survival on the second."""
    rows = features(spark, d)
    early = F.col("cycle_ts") < HALF
    aggs, cells = [], []
    for i, names in enumerate(_COMBOS):
        on = F.expr(_combo(names))
        right = on & ((F.col("next_d") > 0) if _EXPECTED[names[0]] == "UP" else (F.col("next_d") < 0))
        aggs += [F.count_if(on & early).alias(f"a{i}"), F.count_if(right & early).alias(f"b{i}"), F.count_if(on & ~early).alias(f"c{i}"), F.count_if(right & ~early).alias(f"d{i}")]
        cells.append(F.struct(F.lit(" & ".join(names)).alias("combination"), F.lit(len(names)).alias("size"), F.col(f"a{i}").alias("n_disc"), F.col(f"b{i}").alias("k_disc"), F.col(f"c{i}").alias("n_val"), F.col(f"d{i}").alias("k_val")))
    g = rows.agg(*aggs).select(F.inline(F.array(*cells)))
    n, k = F.col("n_disc"), F.col("k_disc")
    holds = lambda a, b: (F.col(a) >= 5) & (F.col(b) > 0.5 * F.col(a))
    return g.withColumn("p", F.when(n > 0, F.round(stats.normal_p(k, F.nullif(n, F.lit(0)), F.lit(0.5)), 7))).withColumn("survives", holds("n_disc", "k_disc") & holds("n_val", "k_val"))


@query(
    """WITH s AS (SELECT e, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS e FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY 1),
z AS (SELECT vec_id, label, list((x - m) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END ORDER BY e) AS v FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS e FROM embeddings) JOIN s USING (e) GROUP BY 1, 2),
n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM z), p AS (SELECT a.label = b.label AS same, list_dot_product(a.u, b.u) AS sim FROM n a JOIN n b ON a.vec_id < b.vec_id)
SELECT same, count(*) AS pairs, round(avg(sim), 7) AS mean_similarity FROM p GROUP BY 1"""
)
def discrimination(spark, d):
    """JN16, ST24, ST25: mean standardised cosine of all pairs of vectors with the same and with different labels; means and
    deviations come from two thirds.

    No pair is made: over a group of unit vectors the sum of all products of two is half of |sum|^2 - count. The mean over
    pairs of different labels is the exact value that random pairs estimate.
    """
    x = src.table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("e", "x")).withColumn("x", F.col("x").cast("double"))
    s = x.filter(F.col("vec_id") % 3 != 0).groupBy("e").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))  # one row a dimension
    z = x.join(F.broadcast(s), "e").withColumn("z", (F.col("x") - F.col("m")) / F.when(F.col("sd") <= 1e-12, 1.0).otherwise(F.col("sd")))
    norms = z.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"))
    u = z.join(norms, "vec_id").withColumn("u", F.col("z") / F.col("norm"))
    sums = u.groupBy("label", "e").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    own = per.agg(F.sum((F.col("sq") - F.col("n")) / 2).alias("same_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same_n"), F.sum("n").alias("n"))
    whole = sums.groupBy("e").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    r = own.join(F.broadcast(whole))  # one row each
    all_sum, all_n = (F.col("sq") - F.col("n")) / 2, F.col("n") * (F.col("n") - 1) / 2
    rows = F.array(F.struct(F.lit(True).alias("same"), F.col("same_n").cast("long").alias("pairs"), F.col("same_sum").alias("total")), F.struct(F.lit(False).alias("same"), (all_n - F.col("same_n")).cast("long").alias("pairs"), (all_sum - F.col("same_sum")).alias("total")))
    return r.select(F.inline(rows)).filter("pairs > 0").select("same", "pairs", F.round(F.col("total") / F.col("pairs"), 7).alias("mean_similarity"))


#: Centroids that are sent to all tasks; more are met in a product of partitions. Share of a cluster's own rows below its threshold.
MOST_CENTROIDS, LOWEST = 1024, 0.1
_SIM_SQL = "round(list_dot_product(list_transform({h}.embedding, lambda v: v::DOUBLE), c) / sqrt(list_dot_product(list_transform({h}.embedding, lambda v: v::DOUBLE), list_transform({h}.embedding, lambda v: v::DOUBLE)) * list_dot_product(c, c)), 4)"


@query(
    f"""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS e FROM embeddings), c AS (SELECT label AS centroid, list(m ORDER BY e) AS c FROM (SELECT label, e, avg(x) AS m FROM x WHERE vec_id % 3 <> 0 GROUP BY 1, 2) GROUP BY 1),
th AS (SELECT centroid, quantile_cont({_SIM_SQL.format(h='t')}, {LOWEST}) AS threshold FROM embeddings t JOIN c ON t.label = centroid WHERE t.vec_id % 3 <> 0 GROUP BY 1), j AS (SELECT h.vec_id, h.label, centroid, {_SIM_SQL.format(h='h')} AS sim FROM embeddings h, c WHERE h.vec_id % 3 = 0)
SELECT j.centroid, round(any_value(threshold), 4) AS threshold, count(*) AS holdout, count(*) FILTER (sim >= threshold) AS covered, count(*) FILTER (sim >= threshold AND label = j.centroid) AS right_label, round(max(sim), 4) AS best FROM j JOIN th ON th.centroid = j.centroid GROUP BY 1"""
)
def centroid_coverage(spark, d):
    """JN14, AG20: labels' centroids from two thirds of the vectors against the holdout: how many each covers by its own threshold, which all
    but a tenth of its own vectors reach, and how many of them have its label."""
    v = src.table(spark, d, "embeddings")
    x = v.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("e", "x"))
    c = x.filter(F.col("vec_id") % 3 != 0).groupBy("label", "e").agg(F.avg("x").alias("m")).groupBy(F.col("label").alias("centroid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "m"))), lambda p: p["m"]).alias("c"))
    c = written(c, "centroids")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
    sim = F.round(dot("v", "c") / F.sqrt(dot("v", "v") * dot("c", "c")), 4)  # 20,001 values at most, which a percentile holds
    rows = v.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    own = rows.filter(F.col("vec_id") % 3 != 0).join(c, F.col("label") == F.col("centroid")).groupBy("centroid").agg(F.percentile(sim, LOWEST).alias("threshold"))
    sides = c.join(own, "centroid")
    few = F.broadcast(sides) if c.count() <= MOST_CENTROIDS else sides
    j = rows.filter(F.col("vec_id") % 3 == 0).crossJoin(few).withColumn("sim", sim)
    on = F.col("sim") >= F.col("threshold")
    return j.groupBy("centroid", "threshold").agg(F.count("*").alias("holdout"), F.count_if(on).alias("covered"), F.count_if(on & (F.col("label") == F.col("centroid"))).alias("right_label"), F.round(F.max("sim"), 4).alias("best")).withColumn("threshold", F.round("threshold", 4))
