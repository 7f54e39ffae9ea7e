"""Queries of money and reports: EV forms, intervals, cumulative curves, calibration, regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ev, stats
from tidemark.operators.bootstrap import draws_sql, intervals_within
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import SAMPLES_SQL

#: Resamples of bets for an interval.
COST_DRAWS = 2000
# A settled bet per click: version by series, entry by quote, won if the volume is over 35.
BETS_SQL = SAMPLES_SQL + ", bets AS (SELECT event_id, series AS version, t, least(greatest(q, 0.05), 0.95) AS entry, volume > 35 AS win FROM samples WHERE event_type = 'click')"
_PNL = "CASE WHEN win THEN 0.98 / least(greatest(entry + 0.01, 0.01), 0.99) - 1 ELSE -1 END"


def bets(spark, d):
    s = src.samples(spark, d).filter("event_type = 'click'")
    return s.select("event_id", F.col("series").alias("version"), "t", F.least(F.greatest("q", F.lit(0.05)), F.lit(0.95)).alias("entry"), (F.col("volume") > 35).alias("win"))


@query(
    f"""WITH {BETS_SQL} SELECT event_id, round(0.644 * (0.98 / (entry + 0.01) - 1) - 0.356, 6) AS ev1, round({_PNL}, 6) AS ev2, round(CASE WHEN win THEN 0.98 / entry - 1 ELSE -1 END, 6) AS ev4,
  round(CASE WHEN win THEN 0.98 / coalesce(CASE WHEN entry > 0.1 THEN entry END, 0.51) - 1 ELSE -1 END, 6) AS ev5, round(0.644 * 0.98 / entry - 1, 6) AS ev6, round((entry + 0.01) / 0.98, 6) AS break_even FROM bets"""
)
def bet_values(spark, d):
    """EV1 to EV6, EV9, EV15, ST26: the forms of expected and realised value."""
    e, p = F.col("entry"), F.lit(0.644)
    return bets(spark, d).select(
        "event_id", r6(ev.expected(p, e)).alias("ev1"), r6(ev.realised(F.col("win"), e)).alias("ev2"), r6(ev.realised_plain(F.col("win"), e)).alias("ev4"),
        r6(ev.realised_or_fallback(F.col("win"), F.when(e > 0.1, e))).alias("ev5"), r6(ev.at_research_rate(p, e)).alias("ev6"), r6(ev.break_even(e)).alias("break_even"),
    )


# Cost scenarios by name, fee and premium.
COSTS = (("real", 0.02, 0.01), ("cheap", 0.0, 0.0), ("dear", 0.04, 0.02))


@query(
    f"""WITH {BETS_SQL}, s(place, name, fee, premium) AS (VALUES {', '.join(f"({k}, '{n}', {f}, {p})" for k, (n, f, p) in enumerate(COSTS))}),
paid AS (SELECT place, name, version, event_id, CASE WHEN win THEN (1 - fee) / least(greatest(entry + premium, 0.01), 0.99) - 1 ELSE -1 END AS pnl, 1 AS one FROM bets JOIN s ON true),
{draws_sql('paid', ['event_id'], COST_DRAWS)}, means AS (SELECT place, version, r, sum(w * pnl) / nullif(sum(w), 0) AS mean FROM paid JOIN drawn USING (event_id) GROUP BY 1, 2, 3),
ends AS (SELECT place, version, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM means GROUP BY 1, 2), g AS (SELECT place, name, version, count(*) AS n, avg(pnl) AS mean FROM paid GROUP BY 1, 2, 3)
SELECT name, version, n, round(mean, 5) AS mean_pnl, round(lo, 5) AS lo, round(hi, 5) AS hi FROM g JOIN ends USING (place, version)"""
)
def cost_scenarios(spark, d):
    """EV8, EV16: three cost scenarios over every bet, with the 95 % bootstrap interval of what a bet gives; a bet has one
    weight in all scenarios."""
    cases = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), F.lit(f).alias("fee"), F.lit(p).alias("premium")) for k, (n, f, p) in enumerate(COSTS)))
    b = bets(spark, d).select("event_id", "version", "entry", "win", F.inline(cases))
    cost = F.least(F.greatest(F.col("entry") + F.col("premium"), F.lit(0.01)), F.lit(0.99))
    b = b.withColumns({"pnl": F.when(F.col("win"), (1 - F.col("fee")) / cost - 1).otherwise(-1.0), "one": F.lit(1), "grp": F.col("version") * len(COSTS) + F.col("place")})
    g = b.groupBy("grp", "name", "version").agg(F.count("*").alias("n"), F.round(F.avg("pnl"), 5).alias("mean_pnl"))
    ends = intervals_within(b, "version", "grp", ["event_id"], "pnl", "one", COST_DRAWS)
    return g.join(ends, "grp").select("name", "version", "n", "mean_pnl", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


@query(
    f"""WITH {BETS_SQL}, x AS (SELECT *, {_PNL} AS pnl FROM bets), y AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN win THEN 1 ELSE 0 END) OVER w AS k, sum(pnl) OVER w AS equity FROM x WINDOW w AS (PARTITION BY version ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, greatest(max(equity) OVER (PARTITION BY version ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM y)
SELECT version, event_id, CAST(n AS INTEGER) AS n, round(k / n, 6) AS win_rate, round(equity, 4) AS equity, round(peak - equity, 4) AS drawdown FROM z"""
)
def cumulative_curves(spark, d):
    """WF13, WF15: cumulative win rate, equity curve and drawdown from a peak of at least 0."""
    w = Window.partitionBy("version").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    b = bets(spark, d).withColumn("pnl", ev.realised(F.col("win"), F.col("entry")))
    b = b.withColumns({"n": F.count("*").over(w).cast("int"), "k": F.sum(F.col("win").cast("int")).over(w), "equity": F.sum("pnl").over(w)})
    b = b.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0)))
    return b.select("version", "event_id", "n", r6(F.col("k") / F.col("n")).alias("win_rate"), F.round("equity", 4).alias("equity"), F.round(F.col("peak") - F.col("equity"), 4).alias("drawdown"))


_W = "(k / n + {z} * {z} / (2 * n) {s} {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4.0 * n * n))) / (1 + {z} * {z} / n)"


@query(
    f"""WITH {BETS_SQL}, g AS (SELECT version, CAST(t // 86400000 AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (win) AS DOUBLE) AS k FROM bets GROUP BY 1, 2)
SELECT version, day, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(greatest(0, {_W.format(z=1.959964, s='-')}), 6) AS st1_lo, round(least(1, {_W.format(z=1.959964, s='+')}), 6) AS st1_hi,
  round(greatest(0, {_W.format(z=1.96, s='-')}), 6) AS st2_lo, round({_W.format(z=1.96, s='+')}, 6) AS st4_hi, round(2.8016 * 0.5 / sqrt(n), 6) AS min_effect FROM g"""
)
def daily_intervals(spark, d):
    """ST1 to ST5, ST10: the Wilson variants and the minimum detectable effect, by day."""
    g = bets(spark, d).groupBy("version", F.floor(F.col("t") / 86_400_000).alias("day")).agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
    one = stats.wilson_bounds(F.col("k"), F.col("n"), 1.959964, (0, 1))
    four = stats.wilson_bounds(F.col("k"), F.col("n"), 1.96, (None, None), clamp=False)
    return g.select("version", "day", "n", "k", r6(one["lo"]).alias("st1_lo"), r6(one["hi"]).alias("st1_hi"), r6(stats.wilson_lower(F.col("k"), F.col("n"))).alias("st2_lo"), r6(four["hi"]).alias("st4_hi"), r6(stats.minimum_effect(F.col("n"))).alias("min_effect"))


@query(
    f"""WITH {BETS_SQL}, x AS (SELECT win, entry, CASE WHEN entry < 0.5 THEN 0 WHEN entry < 0.6 THEN 1 WHEN entry < 0.7 THEN 2 WHEN entry < 0.8 THEN 3 WHEN entry < 0.9 THEN 4 ELSE 5 END AS bucket FROM bets)
SELECT bucket, count(*) AS n, round(avg(entry), 6) AS mean_confidence, round(avg(CASE WHEN win THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) - avg(entry), 6) AS gap FROM x GROUP BY 1"""
)
def calibration(spark, d):
    """AG7: confidence buckets with hit rate and gap; empty buckets are left out."""
    e = F.col("entry")
    b = F.when(e < 0.5, 0).when(e < 0.6, 1).when(e < 0.7, 2).when(e < 0.8, 3).when(e < 0.9, 4).otherwise(5)
    hit = F.avg(F.col("win").cast("double"))
    return bets(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("entry")).alias("mean_confidence"), r6(hit).alias("hit_rate"), r6(hit - F.avg("entry")).alias("gap"))


@query(
    f"""WITH {BETS_SQL}, x AS (SELECT *, CASE WHEN t < 1705276800000 THEN 'before' ELSE 'after' END AS phase, {_PNL} AS pnl FROM bets)
SELECT version, phase, count(*) AS n, count(*) FILTER (win) AS k, round(avg(pnl), 5) AS mean_pnl, CAST(grouping(version) * 2 + grouping(phase) AS INTEGER) AS level FROM x GROUP BY GROUPING SETS ((version, phase), (version), (phase), ())"""
)
def regime_phases(spark, d):
    """AG1: versions and phases with their subtotals in one pass."""
    b = bets(spark, d).withColumns({"phase": F.when(F.col("t") < 1_705_276_800_000, "before").otherwise("after"), "pnl": ev.realised(F.col("win"), F.col("entry"))})
    g = b.cube("version", "phase").agg(F.count("*").alias("n"), F.count_if("win").alias("k"), F.round(F.avg("pnl"), 5).alias("mean_pnl"), F.grouping_id().cast("int").alias("level"))
    return g.select("version", "phase", "n", "k", "mean_pnl", "level")


@query(
    f"""WITH {BETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY version) AS n FROM bets),
g AS (SELECT version, count(*) AS n, count(*) FILTER (win) AS k, count(*) FILTER (rn > CAST(floor(0.75 * n) AS BIGINT)) AS n_last, count(*) FILTER (win AND rn > CAST(floor(0.75 * n) AS BIGINT)) AS k_last FROM o GROUP BY 1),
w AS (SELECT *, {_W.format(z=1.96, s='-')} AS wl FROM (SELECT version, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, n_last, k_last FROM g))
SELECT version, CAST(n AS BIGINT) AS n, round(k / n, 6) AS win_rate, round(k / n * 0.9216 - (1 - k / n), 6) AS ev7, CASE WHEN n >= 50 AND wl >= 0.55 THEN 'S' WHEN n >= 30 AND wl >= 0.52 THEN 'A' WHEN n >= 10 AND k / n >= 0.5 THEN 'B' ELSE 'C' END AS tier,
  n_last >= 10 AND k_last / n_last < 0.5 AS decayed FROM w"""
)
def version_tiers(spark, d):
    """AG40, EV7, TB15: tiers by Wilson bound, and decay in the newest quarter (`reevaluated_patterns` demotes by it)."""
    w = Window.partitionBy("version")
    b = bets(spark, d).withColumns({"rn": F.row_number().over(w.orderBy("t", "event_id")), "all": F.count("*").over(w)})
    last = F.col("rn") > F.floor(0.75 * F.col("all"))
    g = b.groupBy("version").agg(F.count("*").alias("n"), F.count_if("win").alias("k"), F.count_if(last).alias("n_last"), F.count_if(last & F.col("win")).alias("k_last"))
    p, lo, n = F.col("k") / F.col("n"), stats.wilson_lower(F.col("k"), F.col("n")), F.col("n")
    tier = F.when((n >= 50) & (lo >= 0.55), "S").when((n >= 30) & (lo >= 0.52), "A").when((n >= 10) & (p >= 0.5), "B").otherwise("C")
    return g.select("version", "n", r6(p).alias("win_rate"), r6(ev.fixed_price(p)).alias("ev7"), tier.alias("tier"), ((F.col("n_last") >= 10) & (F.col("k_last") < 0.5 * F.col("n_last"))).alias("decayed"))


@query(
    f"""WITH {BETS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY t DESC, event_id DESC) AS rn FROM bets WHERE entry < 0.9), s AS (SELECT *, max(CASE WHEN win THEN 1 ELSE 0 END) OVER (PARTITION BY version ORDER BY rn ROWS UNBOUNDED PRECEDING) AS stopped FROM r WHERE rn <= 50)
SELECT version, count(*) FILTER (stopped = 0) AS loss_streak FROM s GROUP BY 1"""
)
def loss_streaks(spark, d):
    """WF30, AG12: newest-first run of losses among the 50 newest settled bets."""
    w = Window.partitionBy("version")
    r = bets(spark, d).filter("entry < 0.9").withColumn("rn", F.row_number().over(w.orderBy(F.desc("t"), F.desc("event_id")))).filter("rn <= 50")
    r = r.withColumn("stopped", F.max(F.col("win").cast("int")).over(w.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("version").agg(F.count_if(F.col("stopped") == 0).alias("loss_streak"))


@query(
    f"""WITH {SAMPLES_SQL}, x AS (SELECT event_type AS phase, t, volume, volume > 30 AS ok FROM samples), m AS (SELECT max(t) AS now FROM x)
SELECT phase, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(volume), 5) AS mean_duration, round(sum(volume * 0.5 / 1000000), 9) AS cost, CAST((any_value(now) - max(t) FILTER (ok)) // 1000 AS BIGINT) AS age_s,
  CASE WHEN avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) < 0.3 THEN 'CRITICAL' WHEN avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) < 0.5 THEN 'WARN' ELSE 'OK' END AS level FROM x, m GROUP BY 1"""
)
def phase_health(spark, d):
    """AG11: success, duration, cost, age and level of each kind of event that occurs (`phase_report` and `alert_rows` have the fixed phases)."""
    s = src.samples(spark, d).withColumn("ok", F.col("volume") > 30)
    now = s.agg(F.max("t").alias("now"))
    g = s.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("rate"), F.avg("volume").alias("mean"), F.sum(F.col("volume") * 0.5 / 1_000_000).alias("cost"), F.max(F.when(F.col("ok"), F.col("t"))).alias("last_ok"))
    g = g.join(F.broadcast(now))  # one row
    level = F.when(F.col("rate") < 0.3, "CRITICAL").when(F.col("rate") < 0.5, "WARN").otherwise("OK")
    return g.select("phase", "n", r6("rate").alias("success_rate"), F.round("mean", 5).alias("mean_duration"), F.round("cost", 9).alias("cost"), F.floor((F.col("now") - F.col("last_ok")) / 1000).alias("age_s"), level.alias("level"))
