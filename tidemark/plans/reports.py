"""Reports over signals: groups on two settlement bases, families by regime and day, patterns with months, tiers and demotion, prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ev, stats
from tidemark.plans import detection, scenes
from tidemark.plans.accounting import _PNL, _W, BETS_SQL, bets
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import W, r6
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, CYCLES_SQL, HOUR_MS

CYCLE_MS, DAY_MS = 3 * HOUR_MS, 24 * HOUR_MS
#: Rows that a month needs to count, least share of a weak month.
MONTH_LEAST = 5
_LEVEL = "CASE WHEN level < 0.7 THEN 'low' WHEN level < 0.95 THEN 'mid' ELSE 'high' END"
_GROUP_SQL = f"""{CYCLES_SQL}, brk AS ({ORACLE_SQL["break_events"]}), cand AS ({ORACLE_SQL["candle_patterns"]}),
sig AS (SELECT b.series, b.cycle_ts, b.bar_ts, b.side, {_LEVEL} AS level, nullif(c.pattern, 'none') AS pattern, CASE b.side WHEN 'high' THEN 'DOWN' ELSE 'UP' END AS wins_if, CASE WHEN y.c > y.o THEN 'UP' WHEN y.c < y.o THEN 'DOWN' WHEN y.c = y.o THEN 'NOISE' END AS far, n.outcome AS near
  FROM brk b JOIN cand c ON b.series = c.series AND b.bar_ts = c.bar_ts LEFT JOIN cycles y ON y.series = b.series AND y.cycle_ts = b.cycle_ts + {CYCLE_MS} LEFT JOIN bars n ON n.series = b.series AND n.bar_ts = b.bar_ts + {HOUR_MS})"""


def settled_breaks(spark, d):
    """Breaks with their level's class and candle pattern, settled by the next cycle and by the next bar, each null where it is missing."""
    b = detection.break_events(spark, d).withColumn("level", F.expr(_LEVEL))
    c = detection.candle_patterns(spark, d).select("series", "bar_ts", F.nullif("pattern", F.lit("none")).alias("pattern"))
    bars = src.bars(spark, d)
    far = src.cycles(bars).select("series", (F.col("cycle_ts") - CYCLE_MS).alias("cycle_ts"), src.outcome(F.col("c") - F.col("o")).alias("far"))
    near = bars.select("series", (F.col("bar_ts") - HOUR_MS).alias("bar_ts"), F.col("outcome").alias("near"))
    x = b.join(c, ["series", "bar_ts"]).join(far, ["series", "cycle_ts"], "left").join(near, ["series", "bar_ts"], "left")
    return x.withColumn("wins_if", F.when(F.col("side") == "high", "DOWN").otherwise("UP"))


@query(
    f"""WITH {_GROUP_SQL}, g AS (SELECT level, side, coalesce(pattern, 'legacy') AS pattern, count(far) AS settled_far, count(*) FILTER (far = wins_if) AS wins_far, count(near) AS settled_near, count(*) FILTER (near = wins_if) AS wins_near FROM sig GROUP BY 1, 2, 3)
SELECT *, CASE WHEN settled_far > 0 THEN round(wins_far / settled_far, 6) END AS rate_far, CASE WHEN settled_near > 0 THEN round(wins_near / settled_near, 6) END AS rate_near FROM g"""
)
def signal_groups(spark, d):
    """AG2: signals by level, side and pattern, on two bases: settled and won by the next cycle and by the next bar (a high break wins
    where the market falls); an unsettled basis counts nothing."""
    won = lambda c: F.count_if(F.col(c) == F.col("wins_if"))
    g = settled_breaks(spark, d).groupBy("level", "side", F.coalesce("pattern", F.lit("legacy")).alias("pattern")).agg(F.count("far").alias("settled_far"), won("far").alias("wins_far"), F.count("near").alias("settled_near"), won("near").alias("wins_near"))
    rate = lambda k, n: r6(F.col(k) / F.nullif(F.col(n), F.lit(0)))
    return g.select("*", rate("wins_far", "settled_far").alias("rate_far"), rate("wins_near", "settled_near").alias("rate_near"))


@query(
    f"""WITH {_GROUP_SQL} SELECT pattern, series AS version, count(*) AS n, count(*) FILTER (near = wins_if) AS wins, count(*) FILTER (side = 'high') AS n_high, round(count(*) FILTER (near = wins_if) / count(*), 6) AS win_rate, max(bar_ts) AS newest, CAST(grouping(series) AS INTEGER) AS whole
FROM sig WHERE near IS NOT NULL AND pattern IS NOT NULL GROUP BY GROUPING SETS ((pattern, series), (pattern))"""
)
def live_patterns(spark, d):
    """AG14: live statistics of each pattern and version and of the pattern as a whole: a signal on the high side wins where the next bar
    falls, one on the low side where it rises."""
    x = settled_breaks(spark, d).filter("near IS NOT NULL AND pattern IS NOT NULL").withColumnRenamed("series", "version")
    wins = F.count_if(F.col("near") == F.col("wins_if"))
    g = x.groupingSets([("pattern", "version"), ("pattern",)], "pattern", "version").agg(F.count("*").alias("n"), wins.alias("wins"), F.count_if(F.col("side") == "high").alias("n_high"), r6(wins / F.count("*")).alias("win_rate"), F.max("bar_ts").alias("newest"), F.grouping("version").cast("int").alias("whole"))
    return g.select("pattern", "version", "n", "wins", "n_high", "win_rate", "newest", "whole")


@query(
    f"""WITH s AS ({ORACLE_SQL["settled_scenes"]}), m AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events), x AS (SELECT *, cycle_ts + {CYCLE_MS} AS t FROM s WHERE settled <> 'EXPIRED')
SELECT pattern, count(*) AS settled, count(win) AS decided, count(*) FILTER (win) AS wins, round(avg(CASE WHEN win THEN 1.0 WHEN NOT win THEN 0.0 END), 6) AS win_rate, count(pnl) / count(*) AS covered, round(avg(pnl), 6) AS mean_pnl, round(sum(pnl), 3) AS total_pnl, count(*) FILTER (t >= now - {7 * DAY_MS}) AS n_last_7d FROM x, m GROUP BY 1"""
)
def pattern_types(spark, d):
    """AG1, AG4: settled signals of each pattern: decided and won, value and the share that has one, and how many of the last seven days."""
    now = src.samples(spark, d).agg(F.max("t").alias("now"))
    x = scenes.settled_scenes(spark, d).filter("settled <> 'EXPIRED'").join(F.broadcast(now))  # one row
    recent = F.col("cycle_ts") + CYCLE_MS >= F.col("now") - 7 * DAY_MS
    return x.groupBy("pattern").agg(
        F.count("*").alias("settled"), F.count("win").alias("decided"), F.count_if("win").alias("wins"), r6(F.avg(F.col("win").cast("double"))).alias("win_rate"), (F.count("pnl") / F.count("*")).alias("covered"), r6(F.avg("pnl")).alias("mean_pnl"), F.round(F.sum("pnl"), 3).alias("total_pnl"), F.count_if(recent).alias("n_last_7d"),
    )


@query(
    f"""WITH sh AS ({ORACLE_SQL["shadow_signals"]}), sc AS ({ORACLE_SQL["settled_scenes"]}), u AS (SELECT 'shadow' AS family, version, window_start AS t, win FROM sh WHERE win IS NOT NULL UNION ALL SELECT 'scene', NULL, cycle_ts + {CYCLE_MS}, win FROM sc WHERE win IS NOT NULL),
x AS (SELECT *, CASE WHEN t >= {HALF} THEN 'after' ELSE 'before' END AS phase, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS day FROM u), g AS (
SELECT 'phase' AS kind, NULL AS version, phase, NULL AS day, count(*) AS n, count(*) FILTER (win) AS wins, count(DISTINCT family) AS families FROM x GROUP BY phase UNION ALL
SELECT 'version', version, phase, NULL, count(*), count(*) FILTER (win), count(DISTINCT family) FROM x WHERE family = 'shadow' GROUP BY version, phase UNION ALL SELECT 'day', NULL, NULL, day, count(*), count(*) FILTER (win), count(DISTINCT family) FROM x GROUP BY day)
SELECT *, round(wins / n, 6) AS win_rate FROM g"""
)
def regimes(spark, d):
    """AG5: both families of settled signals together by phase (before and after a time) and by UTC day, and the shadow family by version and
    phase."""
    sh = detection.shadow_signals(spark, d).filter("win IS NOT NULL").select(F.lit("shadow").alias("family"), "version", F.col("window_start").alias("t"), "win")
    sc = scenes.settled_scenes(spark, d).filter("win IS NOT NULL").select(F.lit("scene").alias("family"), F.lit(None).cast("string").alias("version"), (F.col("cycle_ts") + CYCLE_MS).alias("t"), "win")
    x = sh.unionByName(sc).select("family", "version", "win", F.when(F.col("t") >= HALF, "after").otherwise("before").alias("phase"), F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd").alias("day"))
    none = F.lit(None).cast("string")
    counts = (F.count("*").alias("n"), F.count_if("win").alias("wins"), F.countDistinct("family").alias("families"))
    parts = [
        x.groupBy(F.lit("phase").alias("kind"), none.alias("version"), "phase", none.alias("day")).agg(*counts), x.filter("family = 'shadow'").groupBy(F.lit("version").alias("kind"), "version", "phase", none.alias("day")).agg(*counts),
        x.groupBy(F.lit("day").alias("kind"), none.alias("version"), none.alias("phase"), "day").agg(*counts),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("win_rate", r6(F.col("wins") / F.col("n")))


_MONTH = "strftime(make_timestamp({} * 1000), '%Y-%m')"
_DEMOTED = "CASE tier WHEN 'S' THEN 'A' WHEN 'A' THEN 'B' ELSE 'C' END"


@query(
    f"""WITH {BETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY version) AS m FROM bets),
g AS (SELECT version, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (win) AS DOUBLE) AS k, count(*) FILTER (i >= CAST(floor(0.75 * m) AS BIGINT)) AS n_last, count(*) FILTER (win AND i >= CAST(floor(0.75 * m) AS BIGINT)) AS k_last FROM o GROUP BY 1),
ms AS (SELECT version, {_MONTH.format('t')} AS month, count(*) AS n, count(*) FILTER (win) AS k FROM bets GROUP BY 1, 2), s AS (SELECT version, string_agg(month || ':' || k || '/' || n, ' ' ORDER BY month) AS months, min(k / n) FILTER (n >= {MONTH_LEAST}) AS worst FROM ms GROUP BY 1),
w AS (SELECT g.*, months, worst, {_W.format(z=1.96, s='-')} AS wl, {_W.format(z=1.96, s='+')} AS wu FROM g JOIN s USING (version)), t AS (SELECT *, CASE WHEN n >= 50 AND wl >= 0.55 THEN 'S' WHEN n >= 30 AND wl >= 0.52 THEN 'A' WHEN n >= 10 AND k / n >= 0.5 THEN 'B' ELSE 'C' END AS tier, n_last >= 10 AND k_last / n_last < 0.5 AS weak FROM w)
SELECT version, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS win_rate, round(wl, 6) AS lo, round(wu, 6) AS hi, round(k / n * 0.9216 - (1 - k / n), 6) AS ev7, months, round(worst, 6) AS worst_month, n_last, CASE WHEN n_last > 0 THEN round(k_last / n_last, 6) END AS last_rate, tier AS own_tier, CASE WHEN weak THEN {_DEMOTED} ELSE tier END AS tier, weak AND tier <> 'C' AS decay_warning FROM t"""
)
def reevaluated_patterns(spark, d):
    """AG16, AG17, AG33: re-evaluation of each version: record with interval and value at a fixed price, months with wins and rows, the worst of
    those with five rows, the newest quarter, and the tier, one step lower where that quarter is weak."""
    w = Window.partitionBy("version")
    b = bets(spark, d).withColumns({"i": F.row_number().over(w.orderBy("t", "event_id")) - 1, "m": F.count("*").over(w), "month": F.date_format(F.timestamp_millis("t"), "yyyy-MM")})
    last = F.col("i") >= F.floor(0.75 * F.col("m"))
    per = b.groupBy("version", "month").agg(F.count("*").alias("n"), F.count_if("win").alias("k"), F.count_if(last).alias("n_last"), F.count_if(last & F.col("win")).alias("k_last"))
    shown = F.concat(F.col("month"), F.lit(":"), F.col("k"), F.lit("/"), F.col("n"))
    rate = F.col("k") / F.col("n")
    g = per.groupBy("version").agg(F.array_join(F.array_sort(F.collect_list(shown)), " ").alias("months"), F.min(F.when(F.col("n") >= MONTH_LEAST, rate)).alias("worst"), *(F.sum(c).alias(c) for c in ("n", "k", "n_last", "k_last")))
    n, k = F.col("n"), F.col("k")
    ends = stats.wilson_bounds(k, n, 1.96, (None, None), clamp=False)
    tier = F.when((n >= 50) & (ends["lo"] >= 0.55), "S").when((n >= 30) & (ends["lo"] >= 0.52), "A").when((n >= 10) & (rate >= 0.5), "B").otherwise("C")
    g = g.withColumns({"tier": tier, "weak": (F.col("n_last") >= 10) & (F.col("k_last") < 0.5 * F.col("n_last"))})
    return g.select(
        "version", "n", "k", r6(rate).alias("win_rate"), r6(ends["lo"]).alias("lo"), r6(ends["hi"]).alias("hi"), r6(ev.fixed_price(rate)).alias("ev7"), "months", r6("worst").alias("worst_month"), "n_last", r6(F.col("k_last") / F.nullif(F.col("n_last"), F.lit(0))).alias("last_rate"),
        F.col("tier").alias("own_tier"), F.when(F.col("weak"), F.expr(_DEMOTED)).otherwise(F.col("tier")).alias("tier"), (F.col("weak") & (F.col("tier") != "C")).alias("decay_warning"),
    )


@query(
    f"""WITH s AS ({ORACLE_SQL["settled_scenes"]}), v AS (SELECT pattern, win, {_MONTH.format(f'(cycle_ts + {CYCLE_MS})')} AS month FROM s WHERE win IS NOT NULL AND cycle_ts >= {HALF}), m AS (SELECT pattern, month, count(*) AS n, count(*) FILTER (win) AS k FROM v GROUP BY 1, 2),
g AS (SELECT pattern, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, count(*) AS months, count(*) FILTER (n >= {MONTH_LEAST}) AS full_months, min(k / n) FILTER (n >= {MONTH_LEAST}) AS worst FROM m GROUP BY 1)
SELECT pattern, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 4) AS p, round({_W.format(z=1.96, s='-')}, 4) AS lo, round({_W.format(z=1.96, s='+')}, 4) AS hi, months, full_months, round(worst, 4) AS worst_month_p FROM g"""
)
def scene_months(spark, d):
    """AG33: scenes of the second half by pattern: record with interval, and the worst of the months that have at least five."""
    v = scenes.settled_scenes(spark, d).filter((F.col("cycle_ts") >= HALF) & F.col("win").isNotNull())
    m = v.groupBy("pattern", F.date_format(F.timestamp_millis(F.col("cycle_ts") + CYCLE_MS), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
    full = F.col("n") >= MONTH_LEAST
    g = m.groupBy("pattern").agg(F.count("*").alias("months"), F.count_if(full).alias("full_months"), F.min(F.when(full, F.col("k") / F.col("n"))).alias("worst"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    ends = stats.wilson_bounds(F.col("k"), F.col("n"), 1.96, (None, None), clamp=False)
    return g.select("pattern", "n", "k", F.round(F.col("k") / F.col("n"), 4).alias("p"), F.round(ends["lo"], 4).alias("lo"), F.round(ends["hi"], 4).alias("hi"), "months", "full_months", F.round("worst", 4).alias("worst_month_p"))


#: Minutes of a window at which its two quotes are read.
READ_MS = 30 * 60_000
_GAIN = "CASE WHEN {} THEN 0.98 / least(greatest({} + 0.01, 0.01), 0.99) - 1 ELSE -1 END"


@query(
    f"""WITH {BARS_SQL}, p AS (SELECT series, CAST(floor(t / {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS bar_ts, arg_max(q, (t, event_id)) FILTER (event_id % 2 = 0) AS up, 1 - arg_max(q, (t, event_id)) FILTER (event_id % 2 = 1) AS down FROM samples WHERE t % {HOUR_MS} <= {READ_MS} GROUP BY 1, 2),
x AS (SELECT up, down, greatest(up, down) AS fav, least(up, down) AS dog, CASE WHEN up >= down THEN outcome = 'UP' ELSE outcome = 'DOWN' END AS won FROM p JOIN bars b ON b.series = p.series AND b.bar_ts = p.bar_ts WHERE outcome <> 'NOISE' AND up IS NOT NULL AND down IS NOT NULL),
g AS (SELECT CAST(least(9, floor(fav * 10)) AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (won) AS DOUBLE) AS k, avg(fav) AS price, avg(up + down - 1) AS vig, avg({_GAIN.format('won', 'fav')}) AS ev_fav, avg({_GAIN.format('NOT won', 'dog')}) AS ev_fade FROM x GROUP BY 1)
SELECT bucket, CAST(n AS BIGINT) AS n, round(price, 6) AS price, round(k / n, 6) AS win_rate, round({_W.format(z=1.96, s='-')}, 6) AS lo, round({_W.format(z=1.96, s='+')}, 6) AS hi, round(k / n - price, 6) AS gap, round(vig, 6) AS vig, round(ev_fav, 5) AS ev_favourite, round(ev_fade, 5) AS ev_fade FROM g"""
)
def calibrated_prices(spark, d):
    """AG23: windows by the price of their favourite half-way through: how often it wins with interval and gap, what both sides cost above
    one, and the value of backing and of fading it (quotes of the two sides come from samples with even and odd ids)."""
    s = src.samples(spark, d).filter(F.col("t") % HOUR_MS <= READ_MS).withColumn("bar_ts", src.bucket(F.col("t"), HOUR_MS))
    at, even = F.struct("t", "event_id"), F.col("event_id") % 2 == 0
    last = lambda on: F.max_by(F.when(on, F.col("q")), F.when(on, at))
    p = s.groupBy("series", "bar_ts").agg(last(even).alias("up"), (1 - last(~even)).alias("down")).dropna(subset=["up", "down"])
    x = p.join(src.bars(spark, d).filter("outcome <> 'NOISE'").select("series", "bar_ts", "outcome"), ["series", "bar_ts"])
    x = x.select("up", "down", F.greatest("up", "down").alias("fav"), F.least("up", "down").alias("dog"), (F.col("outcome") == F.when(F.col("up") >= F.col("down"), "UP").otherwise("DOWN")).alias("won"))
    g = x.groupBy(F.least(F.lit(9), F.floor(F.col("fav") * 10)).cast("int").alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("won").alias("k"), F.avg("fav").alias("price"), F.avg(F.col("up") + F.col("down") - 1).alias("vig"), F.avg(ev.realised(F.col("won"), F.col("fav"))).alias("ev_fav"), F.avg(ev.realised(~F.col("won"), F.col("dog"))).alias("ev_fade"),
    )
    ends, rate = stats.wilson_bounds(F.col("k"), F.col("n"), 1.96, (None, None), clamp=False), F.col("k") / F.col("n")
    return g.select("bucket", "n", r6("price").alias("price"), r6(rate).alias("win_rate"), r6(ends["lo"]).alias("lo"), r6(ends["hi"]).alias("hi"), r6(rate - F.col("price")).alias("gap"), r6("vig").alias("vig"), F.round("ev_fav", 5).alias("ev_favourite"), F.round("ev_fade", 5).alias("ev_fade"))


@query(
    f"""WITH {BETS_SQL}, x AS (SELECT *, {_PNL} AS pnl, CASE WHEN event_id % 7 = 0 THEN round(entry, 4) END AS stored FROM bets), y AS (SELECT *, row_number() OVER w AS i, sum(CASE WHEN win THEN 1 ELSE 0 END) OVER w AS k, sum(pnl) OVER w AS equity FROM x WINDOW w AS (PARTITION BY version, t // {DAY_MS} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT version, t // {DAY_MS} AS day, count(*) AS n, count(*) FILTER (win) AS k, sum(pnl) AS pnl FROM x GROUP BY 1, 2), b AS (SELECT version, day, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(k) OVER w, 0) AS k0, coalesce(sum(pnl) OVER w, 0) AS e0 FROM d WINDOW w AS (PARTITION BY version ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT y.version, event_id, CAST(i + n0 AS BIGINT) AS i, round(coalesce(stored, (y.k + k0) / (i + n0)), 6) AS cum_win_rate, stored IS NOT NULL AS from_store, round(equity + e0, 4) AS cum_ev FROM y JOIN b ON y.version = b.version AND y.t // {DAY_MS} = b.day"""
)
def stored_curves(spark, d):
    """WF14: cumulative win rate and value of each version, where a stored rate (every seventh bet has one) overrides the computed one.
    Days are summed first and carried forward, so a task sorts one day of a version."""
    b = bets(spark, d).withColumns({"pnl": ev.realised(F.col("win"), F.col("entry")), "day": F.floor(F.col("t") / DAY_MS), "stored": F.when(F.col("event_id") % 7 == 0, F.round("entry", 4))})
    w = Window.partitionBy("version", "day").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    y = b.withColumns({"i": F.count("*").over(w), "k": F.sum(F.col("win").cast("int")).over(w), "equity": F.sum("pnl").over(w)})
    before = Window.partitionBy("version").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = b.groupBy("version", "day").agg(F.count("*").alias("n"), F.count_if("win").alias("won"), F.sum("pnl").alias("gain"))
    days = days.select("version", "day", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "won", "gain")))
    y = y.join(days, ["version", "day"])
    place = F.col("i") + F.col("n_before")
    return y.select("version", "event_id", place.alias("i"), r6(F.coalesce("stored", (F.col("k") + F.col("won_before")) / place)).alias("cum_win_rate"), F.col("stored").isNotNull().alias("from_store"), F.round(F.col("equity") + F.col("gain_before"), 4).alias("cum_ev"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, c, lag(c) OVER w AS pc, bar_ts - lag(bar_ts) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)), y AS (SELECT *, CASE WHEN gap = {HOUR_MS} THEN CAST(sign(c - pc) AS INTEGER) ELSE 0 END AS dir FROM x),
z AS (SELECT *, lag(dir) OVER w AS before FROM y WINDOW w AS (PARTITION BY series ORDER BY bar_ts)), r AS (SELECT *, sum(CASE WHEN dir = before AND dir <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS run FROM z),
s AS (SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY bar_ts) AS k FROM r) SELECT series, bar_ts, CAST(CASE WHEN dir > 0 THEN k ELSE 0 END AS INTEGER) AS estreak_up, CAST(CASE WHEN dir < 0 THEN k ELSE 0 END AS INTEGER) AS estreak_dn FROM s"""
)
def end_streaks(spark, d):
    """WF9: for how many windows in a row the quote at the end has risen or fallen against the window before; a gap or no change ends both."""
    b = src.bars(spark, d).withColumn("dir", F.when(F.col("bar_ts") - F.lag("bar_ts").over(W()) == HOUR_MS, F.signum(F.col("c") - F.lag("c").over(W()))).otherwise(0).cast("int"))
    b = b.withColumn("same", F.coalesce((F.col("dir") == F.lag("dir").over(W())) & (F.col("dir") != 0), F.lit(False)))
    b = b.withColumn("run", F.sum((~F.col("same")).cast("int")).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    k = F.row_number().over(Window.partitionBy("series", "run").orderBy("bar_ts"))
    b = b.withColumn("k", k)
    return b.select("series", "bar_ts", F.when(F.col("dir") > 0, F.col("k")).otherwise(0).alias("estreak_up"), F.when(F.col("dir") < 0, F.col("k")).otherwise(0).alias("estreak_dn"))


#: A minute of a five-minute cycle is twelve minutes of an hour.
TICK_MS = 720_000


@query(
    f"""WITH {BARS_SQL}, k AS (SELECT series, t // {TICK_MS} AS tick, arg_max(q, (t, event_id)) AS c FROM samples GROUP BY 1, 2), s AS (SELECT *, CAST(floor(t / {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS bar_ts, t // {TICK_MS} AS tick FROM samples)
SELECT s.event_id, s.series, round(b.o, 6) AS o, round(k.c, 6) AS prev_close, round((coalesce(k.c, b.o) / b.o - 1) * 100, 6) AS distance_pct, s.bar_ts + {HOUR_MS} - s.t AS left_ms FROM s JOIN bars b ON b.series = s.series AND b.bar_ts = s.bar_ts LEFT JOIN k ON k.series = s.series AND k.tick = s.tick - 1"""
)
def sample_distances(spark, d):
    """JN11: samples joined with their cycle's bar and with the close of the minute before, by two keys: where the market stood against the
    opening, as it was known then (the opening itself where that minute has no sample)."""
    tick = F.floor(F.col("t") / TICK_MS)
    s = src.samples(spark, d).select("event_id", "series", "t", "q", src.bucket(F.col("t"), HOUR_MS).alias("bar_ts"), tick.alias("tick"))
    k = s.groupBy("series", (F.col("tick") + 1).alias("tick")).agg(F.max_by("q", F.struct("t", "event_id")).alias("prev_close"))
    j = s.join(src.bars(spark, d).select("series", "bar_ts", "o"), ["series", "bar_ts"]).join(k, ["series", "tick"], "left")
    return j.select("event_id", "series", r6("o").alias("o"), r6("prev_close").alias("prev_close"), r6((F.coalesce("prev_close", "o") / F.col("o") - 1) * 100).alias("distance_pct"), (F.col("bar_ts") + HOUR_MS - F.col("t")).alias("left_ms"))


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT series, CAST(floor(t / {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS bar_ts, arg_max(q, (t, event_id)) AS q FROM samples WHERE t % {HOUR_MS} <= {READ_MS} GROUP BY 1, 2),
x AS (SELECT b.series, b.bar_ts, CASE WHEN e.q > b.o * 1.1 THEN 'UP' WHEN e.q < b.o * 0.9 THEN 'DOWN' ELSE 'FLAT' END AS moved, b.outcome, lead(b.bar_ts) OVER w - b.bar_ts AS gap, lead(b.outcome) OVER w AS next_outcome, lead(b.o) OVER w AS next_o FROM bars b LEFT JOIN e ON e.series = b.series AND e.bar_ts = b.bar_ts WINDOW w AS (PARTITION BY b.series ORDER BY b.bar_ts)),
y AS (SELECT moved, next_outcome = moved AS won, CASE WHEN moved = 'UP' THEN next_o ELSE 1 - next_o END AS price, outcome = moved AS kept FROM x WHERE gap = {HOUR_MS} AND moved <> 'FLAT' AND next_outcome <> 'NOISE')
SELECT moved, count(*) AS n, round(avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END), 6) AS kept_rate, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS follow_rate, round(avg({_GAIN.format('won', 'price')}), 5) AS ev_follow, round(avg(CASE WHEN won THEN 0.98 / price - 1 ELSE -1 END), 5) AS ev_follow_plain, round(avg({_GAIN.format('NOT won', '(1 - price)')}), 5) AS ev_fade FROM y GROUP BY 1"""
)
def early_moves(spark, d):
    """DP26, JN8: a move of ten percent in the first half of a window against the window right after it: how often it lasts and goes on, and
    what following it (with and without premium) and fading it earn."""
    at = F.struct("t", "event_id")
    e = src.samples(spark, d).filter(F.col("t") % HOUR_MS <= READ_MS).groupBy("series", src.bucket(F.col("t"), HOUR_MS).alias("bar_ts")).agg(F.max_by("q", at).alias("q"))
    b = src.bars(spark, d).select("series", "bar_ts", "o", "outcome").join(e, ["series", "bar_ts"], "left")
    moved = F.when(F.col("q") > F.col("o") * 1.1, "UP").when(F.col("q") < F.col("o") * 0.9, "DOWN").otherwise("FLAT")
    x = b.select("outcome", moved.alias("moved"), (F.lead("bar_ts").over(W()) - F.col("bar_ts")).alias("gap"), F.lead("outcome").over(W()).alias("next_outcome"), F.lead("o").over(W()).alias("next_o"))
    x = x.filter((F.col("gap") == HOUR_MS) & (F.col("moved") != "FLAT") & (F.col("next_outcome") != "NOISE"))
    won, price = F.col("next_outcome") == F.col("moved"), F.when(F.col("moved") == "UP", F.col("next_o")).otherwise(1 - F.col("next_o"))
    return x.groupBy("moved").agg(
        F.count("*").alias("n"), r6(F.avg((F.col("outcome") == F.col("moved")).cast("double"))).alias("kept_rate"), r6(F.avg(won.cast("double"))).alias("follow_rate"), F.round(F.avg(ev.realised(won, price)), 5).alias("ev_follow"),
        F.round(F.avg(ev.realised_plain(won, price)), 5).alias("ev_follow_plain"), F.round(F.avg(ev.realised(~won, 1 - price)), 5).alias("ev_fade"),
    )


_NEAR = "CASE WHEN side = 'high' THEN level - lag_c ELSE lag_c - level END"


@query(
    f"""WITH {BARS_SQL}, brk AS ({ORACLE_SQL["break_events"]}), st AS ({ORACLE_SQL["outcome_streaks"]}), x AS (SELECT series, bar_ts, lag(c) OVER w AS lag_c, lead(outcome) OVER w AS next_outcome, lead(bar_ts) OVER w - bar_ts AS gap FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
y AS (SELECT b.side, b.fake, st.streak >= 2 AS in_streak, {_NEAR} < 0.2 * b.level AS near, next_outcome = CASE b.side WHEN 'high' THEN 'DOWN' ELSE 'UP' END AS won FROM brk b JOIN x ON b.series = x.series AND b.bar_ts = x.bar_ts JOIN st ON b.series = st.series AND b.bar_ts = st.bar_ts WHERE gap = {HOUR_MS} AND next_outcome <> 'NOISE' AND lag_c IS NOT NULL)
SELECT side, fake, in_streak, near, count(*) AS n, count(*) FILTER (won) AS wins, round(count(*) FILTER (won) / count(*), 6) AS win_rate FROM y GROUP BY 1, 2, 3, 4"""
)
def break_study(spark, d):
    """DP27: breaks of resistance and of support, false or not, inside a streak or not, from near the level or not, and how often the next bar
    turns back."""
    from tidemark.plans.market import outcome_streaks

    b = src.bars(spark, d).select("series", "bar_ts", F.lag("c").over(W()).alias("lag_c"), F.lead("outcome").over(W()).alias("next_outcome"), (F.lead("bar_ts").over(W()) - F.col("bar_ts")).alias("gap"))
    st = outcome_streaks(spark, d).select("series", "bar_ts", (F.col("streak") >= 2).alias("in_streak"))
    y = detection.break_events(spark, d).join(b.filter((F.col("gap") == HOUR_MS) & (F.col("next_outcome") != "NOISE") & F.col("lag_c").isNotNull()), ["series", "bar_ts"]).join(st, ["series", "bar_ts"])
    won = F.col("next_outcome") == F.when(F.col("side") == "high", "DOWN").otherwise("UP")
    g = y.groupBy("side", "fake", "in_streak", (F.expr(_NEAR) < 0.2 * F.col("level")).alias("near")).agg(F.count("*").alias("n"), F.count_if(won).alias("wins"))
    return g.withColumn("win_rate", r6(F.col("wins") / F.col("n")))
