"""Queries of patterns' lives: live lift, death, promotion, re-evaluation, evolution report, research triggers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.accounting import BETS_SQL, bets
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources.events import HOUR_MS

DAY_MS = 24 * HOUR_MS
# Recent hits, floor of the peak, ceiling of the recent lift, least prefix, samples that decide a promotion,
# samples that judge a whole and a half.
RECENT, PEAK_FLOOR, RECENT_CEILING, MIN_PREFIX, PROMOTE_AT, JUDGE_AT, HALF_AT = 20, 1.3, 1.1, 5, 50, 30, 15
METHODS = ("PREDICATE", "CLUSTER", "LEGACY")

# A pattern is a version's 4-hour phase; odd ones are still on probation; every tenth bet was not traded, every thirteenth had no pattern.
_HITS_SQL = BETS_SQL + ", hits AS (SELECT *, version * 6 + t // 14400000 % 6 AS pattern FROM bets)"
_WILSON = "CASE WHEN n > 0 THEN greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) ELSE 0 END"


def hits(spark, d):
    return bets(spark, d).withColumn("pattern", F.col("version") * 6 + F.floor(F.col("t") / 14_400_000) % 6)


@query(
    f"""WITH {_HITS_SQL}, o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY pattern ORDER BY t DESC, event_id DESC) AS back, sum(CASE WHEN win THEN 1 ELSE 0 END) OVER w AS cum FROM hits WINDOW w AS (PARTITION BY pattern ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT version, count(*) AS all_n, count(*) FILTER (win) AS all_k FROM hits GROUP BY 1),
g AS (SELECT pattern, any_value(version) AS version, count(*) AS n, count(*) FILTER (win) AS k, count(*) FILTER (back <= {RECENT}) AS rn, count(*) FILTER (back <= {RECENT} AND win) AS rk, max(cum / i) FILTER (i >= {MIN_PREFIX}) AS peak_rate, (max(t) - min(t)) / 86400000.0::DOUBLE AS days FROM o GROUP BY 1),
b AS (SELECT g.*, all_n - n AS base, all_k - k AS base_k FROM g JOIN v USING (version)),
l AS (SELECT *, CASE WHEN rk > 0 AND base_k > 0 THEN (rk / rn) / (base_k / base) ELSE 0 END AS recent, CASE WHEN rk > 0 AND base_k > 0 THEN sqrt(greatest(1 / rk - 1 / rn + 1 / base_k - 1 / base, 1e-12)) ELSE 0 END AS se, CASE WHEN base_k > 0 AND n >= {MIN_PREFIX} THEN peak_rate / (base_k / base) ELSE 0 END AS peak FROM b),
c AS (SELECT *, CASE WHEN recent > 0 THEN exp(ln(recent) - 1.96 * se) ELSE 0 END AS lo, CASE WHEN recent > 0 THEN exp(ln(recent) + 1.96 * se) ELSE 0 END AS hi FROM l)
SELECT pattern, n, round(recent, 6) AS recent_lift, round(lo, 6) AS recent_lo, round(hi, 6) AS recent_hi, round(peak, 6) AS peak_lift, round(days, 2) AS lifespan_days,
  CASE WHEN n < {RECENT} THEN 'ALIVE' WHEN peak >= {PEAK_FLOOR} AND recent < {RECENT_CEILING} THEN 'EXPIRED' WHEN lo <= 1 AND hi >= 1 AND peak < {PEAK_FLOOR} THEN 'SPURIOUS' ELSE 'ALIVE' END AS cause FROM c"""
)
def death_diagnosis(spark, d):
    """ST15, ST16, DP19: lift of the newest 20 hits and the best of all prefixes over the version's other bets, and what a pattern died of."""
    w = Window.partitionBy("pattern")
    h = hits(spark, d)
    order = w.orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    o = h.withColumns({"i": F.row_number().over(w.orderBy("t", "event_id")), "back": F.row_number().over(w.orderBy(F.desc("t"), F.desc("event_id"))), "cum": F.sum(F.col("win").cast("int")).over(order)})
    recent = F.col("back") <= RECENT
    g = o.groupBy("pattern", "version").agg(
        F.count("*").alias("n"), F.count_if("win").alias("k"), F.count_if(recent).alias("rn"), F.count_if(recent & F.col("win")).alias("rk"), F.max(F.when(F.col("i") >= MIN_PREFIX, F.col("cum") / F.col("i"))).alias("peak_rate"), ((F.max("t") - F.min("t")) / DAY_MS).alias("days")
    )
    of_version = h.groupBy("version").agg(F.count("*").alias("all_n"), F.count_if("win").alias("all_k"))
    g = g.join(of_version, "version").withColumns({"base": F.col("all_n") - F.col("n"), "base_k": F.col("all_k") - F.col("k")})
    g = g.withColumn("l", stats.lift(F.col("rk"), F.col("rn"), F.col("base_k"), F.col("base")))
    peak = F.when((F.col("base_k") > 0) & (F.col("n") >= MIN_PREFIX), F.col("peak_rate") / (F.col("base_k") / F.col("base"))).otherwise(0.0)
    g = g.withColumn("peak", peak)
    cause = F.when(F.col("n") < RECENT, "ALIVE").when((F.col("peak") >= PEAK_FLOOR) & (F.col("l.lift") < RECENT_CEILING), "EXPIRED").when((F.col("l.lo") <= 1) & (F.col("l.hi") >= 1) & (F.col("peak") < PEAK_FLOOR), "SPURIOUS").otherwise("ALIVE")
    return g.select("pattern", "n", r6("l.lift").alias("recent_lift"), r6("l.lo").alias("recent_lo"), r6("l.hi").alias("recent_hi"), r6("peak").alias("peak_lift"), F.round("days", 2).alias("lifespan_days"), cause.alias("cause"))


@query(
    f"""WITH {_HITS_SQL}, g AS (SELECT pattern, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (win) AS DOUBLE) AS k, count(*) FILTER (t < {HALF}) AS n0, count(*) FILTER (t < {HALF} AND win) AS k0 FROM hits GROUP BY 1),
b AS (SELECT *, {_WILSON} AS lb, pattern % 2 = 1 AS evolving FROM g), a AS (SELECT sum(k) FILTER (NOT evolving) / nullif(sum(n) FILTER (NOT evolving), 0) AS active_rate FROM b)
SELECT pattern, CASE WHEN evolving THEN 'EVOLVING' ELSE 'ACTIVE' END AS status, CAST(n AS BIGINT) AS n, round(lb, 6) AS wilson_lo, CASE WHEN NOT evolving THEN 'KEEP' WHEN n < {PROMOTE_AT} THEN 'WATCH' WHEN lb > 0.5 THEN 'PROMOTE' ELSE 'RETIRE' END AS action, CASE WHEN evolving AND n >= {PROMOTE_AT} AND lb > 0.5 THEN round(lb, 6) END AS confidence,
  CAST(n - n0 AS BIGINT) AS new_samples, CASE WHEN n0 > 0 THEN round(k / n - k0 / n0, 6) END AS drift, CASE WHEN n0 > 0 AND k / n < k0 / n0 - 0.05 THEN 'weaken' WHEN n0 > 0 AND k / n > k0 / n0 + 0.05 THEN 'strengthen' WHEN n0 > 0 THEN 'keep' ELSE 'new' END AS suggestion, evolving AND n >= {JUDGE_AT} AND k / n >= active_rate AS hint FROM b, a"""
)
def promotions(spark, d):
    """ST17, DP20, DP31, AG18: what becomes of patterns on probation, drift and new samples since the run at half time, shadow promotion hints."""
    before = F.col("t") < HALF
    g = hits(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("win").alias("k"), F.count_if(before).alias("n0"), F.count_if(before & F.col("win")).alias("k0"))
    g = g.withColumns({"lb": stats.wilson_lower(F.col("k"), F.col("n")), "evolving": F.col("pattern") % 2 == 1})
    active = g.agg((F.sum(F.when(~F.col("evolving"), F.col("k"))) / F.nullif(F.sum(F.when(~F.col("evolving"), F.col("n"))), F.lit(0))).alias("active_rate"))
    g = g.join(F.broadcast(active))  # one row
    decides, rate, old = F.col("n") >= PROMOTE_AT, F.col("k") / F.col("n"), F.when(F.col("n0") > 0, F.col("k0") / F.col("n0"))
    action = F.when(~F.col("evolving"), "KEEP").when(~decides, "WATCH").when(F.col("lb") > 0.5, "PROMOTE").otherwise("RETIRE")
    change = F.when(old.isNull(), "new").when(rate < old - 0.05, "weaken").when(rate > old + 0.05, "strengthen").otherwise("keep")
    return g.select(
        "pattern", F.when(F.col("evolving"), "EVOLVING").otherwise("ACTIVE").alias("status"), "n", r6("lb").alias("wilson_lo"), action.alias("action"), F.when(F.col("evolving") & decides & (F.col("lb") > 0.5), r6("lb")).alias("confidence"),
        (F.col("n") - F.col("n0")).alias("new_samples"), r6(rate - old).alias("drift"), change.alias("suggestion"), (F.col("evolving") & (F.col("n") >= JUDGE_AT) & (rate >= F.col("active_rate"))).alias("hint"),
    )


def _bucket_sql(key: str) -> str:
    return f"SELECT {key}, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (win) AS DOUBLE) AS k FROM r"


@query(
    f"""WITH {_HITS_SQL}, r AS (SELECT *, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS day, CASE WHEN event_id % 13 = 0 THEN 'UNMATCHED' ELSE ['PREDICATE', 'CLUSTER', 'LEGACY'][pattern % 3 + 1] END AS method,
  CASE WHEN row_number() OVER (ORDER BY t, event_id) <= count(*) OVER () // 2 THEN 'older' ELSE 'newer' END AS half FROM hits WHERE event_id % 10 <> 0),
u AS (SELECT * FROM ({_bucket_sql("'overall' AS section, 'all' AS key")} UNION ALL {_bucket_sql("'daily', day")} GROUP BY day UNION ALL {_bucket_sql("'half', half")} GROUP BY half UNION ALL {_bucket_sql("'method', method")} GROUP BY method)),
s AS (SELECT *, round(k / n, 4) AS win_rate, round({_WILSON}, 4) AS ci_lower, {_WILSON} AS wl FROM u), o AS (SELECT win_rate AS older_rate, n AS older_n FROM s WHERE section = 'half' AND key = 'older')
SELECT section, key, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS correct, win_rate, ci_lower, round(k / n - 0.5, 4) AS excess, wl > 0.5 AS beats_random,
  CASE WHEN section = 'overall' THEN CASE WHEN n < {JUDGE_AT} THEN 'INSUFFICIENT_SAMPLES' WHEN wl > 0.5 THEN 'BEATS_RANDOM' ELSE 'INCONCLUSIVE' END WHEN key = 'newer' THEN CASE WHEN least(n, older_n) < {HALF_AT} THEN 'NOT_COMPARABLE' WHEN ci_lower > older_rate THEN 'IMPROVED' ELSE 'NOT_IMPROVED' END END AS verdict,
  CASE WHEN key = 'newer' THEN round(win_rate - older_rate, 4) END AS delta FROM s, o"""
)
def evolution_report(spark, d):
    """AG3, AG6, DP31: decisive predictions overall, by UTC day, by older and newer half, by discovery method: win rate, lower
    bound, excess over chance, and whether the newer half's bound is above the older half's rate.

    A prediction that is no decision counts nothing; every tenth hit stands for one. The halves are cut at a place in time
    order: counts by second give the place where a second starts, and only the rows of the second at the cut are sorted.
    """
    method = F.when(F.col("event_id") % 13 == 0, "UNMATCHED").otherwise(F.element_at(F.array(*map(F.lit, METHODS)), (F.col("pattern") % 3 + 1).cast("int")))
    r = hits(spark, d).filter(F.col("event_id") % 10 != 0).withColumns({"hour": F.floor(F.col("t") / HOUR_MS), "second": F.floor(F.col("t") / 1000), "day": F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd"), "method": method})
    per_hour = r.groupBy("hour").agg(F.count("*").alias("c"))  # one row an hour
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    starts = per_hour.select("hour", (F.sum("c").over(before) - F.col("c")).alias("before"), F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    # the hour at the cut, one row; in it the second, one row; in that the last row of the older half
    half = F.floor(F.col("total") / 2)
    at_hour = starts.join(per_hour, "hour").filter((F.col("before") < half) & (F.col("before") + F.col("c") >= half)).select(F.col("hour").alias("cut_hour"), F.col("before").alias("hour_before"), half.alias("cut"))
    seconds = r.join(F.broadcast(at_hour), F.col("hour") == F.col("cut_hour")).groupBy("second", "hour_before", "cut").agg(F.count("*").alias("c"))
    so_far = F.col("hour_before") + F.sum("c").over(Window.orderBy("second").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")  # at most 3600 rows
    at_second = seconds.withColumn("so_far", so_far).filter((F.col("so_far") < F.col("cut")) & (F.col("so_far") + F.col("c") >= F.col("cut"))).select(F.col("second").alias("cut_second"), (F.col("cut") - F.col("so_far")).alias("left"))
    inside = r.join(F.broadcast(at_second), F.col("second") == F.col("cut_second"))
    last = inside.withColumn("rn", F.row_number().over(Window.partitionBy("cut_second").orderBy("t", "event_id"))).filter(F.col("rn") == F.col("left")).select(F.col("t").alias("last_t"), F.col("event_id").alias("last_id"))
    r = r.join(F.broadcast(last), how="left").withColumn("half", F.when(F.struct("t", "event_id") <= F.struct("last_t", "last_id"), "older").otherwise("newer"))  # one row
    sections = F.array(*(F.struct(F.lit(s).alias("section"), F.col(k).alias("key") if k else F.lit("all").alias("key")) for s, k in (("overall", None), ("daily", "day"), ("half", "half"), ("method", "method"))))
    g = r.select("win", F.inline(sections)).groupBy("section", "key").agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
    rate, low = F.col("k") / F.col("n"), stats.wilson_lower(F.col("k"), F.col("n"))
    g = g.withColumns({"win_rate": F.round(rate, 4), "wl": low, "ci_lower": F.round(low, 4)})
    older = g.filter("section = 'half' AND key = 'older'").select(F.col("win_rate").alias("older_rate"), F.col("n").alias("older_n"))
    g = g.join(F.broadcast(older))  # one row
    newer = F.col("key") == "newer"
    verdict = F.when(F.col("section") == "overall", F.when(F.col("n") < JUDGE_AT, "INSUFFICIENT_SAMPLES").when(F.col("wl") > 0.5, "BEATS_RANDOM").otherwise("INCONCLUSIVE")).when(newer, F.when(F.least("n", "older_n") < HALF_AT, "NOT_COMPARABLE").when(F.col("ci_lower") > F.col("older_rate"), "IMPROVED").otherwise("NOT_IMPROVED"))
    return g.select("section", "key", "n", F.col("k").alias("correct"), "win_rate", "ci_lower", F.round(rate - 0.5, 4).alias("excess"), (F.col("wl") > 0.5).alias("beats_random"), verdict.alias("verdict"), F.when(newer, F.round(F.col("win_rate") - F.col("older_rate"), 4)).alias("delta"))


@query(
    f"""WITH {_HITS_SQL}, g AS (SELECT pattern, count(*) AS n, count(*) FILTER (win) AS k, (max(t) - min(t)) / 86400000.0::DOUBLE AS days FROM hits GROUP BY 1), m AS (SELECT *, ['PREDICATE', 'CLUSTER', 'LEGACY'][pattern % 3 + 1] AS method FROM g)
SELECT method, count(*) AS patterns, count(*) FILTER (k / n > 0.5) AS positive, round(avg(k / n), 6) AS mean_rate, round(sum(k) / sum(n), 6) AS weighted_rate, round(avg(days), 6) AS mean_days, round(median(round(days, 6)), 6) AS median_days, round(max(days), 6) AS max_days, round(count(*) FILTER (n >= {PROMOTE_AT}) / count(*), 6) AS gate_ratio,
  count(*) FILTER (k / n >= 0.55) AS n_strong, count(*) FILTER (k / n < 0.45) AS n_weak FROM m GROUP BY 1"""
)
def discovery_feedback(spark, d):
    """AG3, AG15, AG19: by discovery method the patterns, positive ones, plain and weighted live rate, lifespans, gate ratio and verdict counts."""
    g = hits(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("win").alias("k"), ((F.max("t") - F.min("t")) / DAY_MS).alias("days"))
    rate = F.col("k") / F.col("n")
    m = g.withColumn("method", F.element_at(F.array(*map(F.lit, METHODS)), (F.col("pattern") % 3 + 1).cast("int"))).groupBy("method")
    return m.agg(
        F.count("*").alias("patterns"), F.count_if(rate > 0.5).alias("positive"), r6(F.avg(rate)).alias("mean_rate"), r6(F.sum("k") / F.sum("n")).alias("weighted_rate"), r6(F.avg("days")).alias("mean_days"), r6(F.percentile(F.round("days", 6), 0.5)).alias("median_days"), r6(F.max("days")).alias("max_days"),
        r6(F.count_if(F.col("n") >= PROMOTE_AT) / F.count("*")).alias("gate_ratio"), F.count_if(rate >= 0.55).alias("n_strong"), F.count_if(rate < 0.45).alias("n_weak"),
    )


# Fixed values of the research trigger: cool-down, interval, new bets, least live bets.
COOL_MS, INTERVAL_MS, NEW_BETS, LEAST_LIVE = 12 * HOUR_MS, 7 * DAY_MS, 100, 30


def _last_run(version: Column) -> Column:
    """A version's last research: none yet, long ago, or just now."""
    return F.when(version % 4 == 3, F.lit(None).cast("long")).when(version % 4 == 2, HALF + 16 * DAY_MS).otherwise(HALF)


@query(
    f"""WITH {BETS_SQL}, m AS (SELECT max(t) AS now FROM bets), r AS (SELECT *, CASE WHEN version % 4 = 3 THEN NULL WHEN version % 4 = 2 THEN {HALF + 16 * DAY_MS} ELSE {HALF} END AS last_run FROM bets, m),
g AS (SELECT version, any_value(last_run) AS last_run, any_value(now) AS now, max(t) AS data_end, count(*) FILTER (t < {HALF}) AS n0, count(*) FILTER (t < {HALF} AND win) AS k0, CAST(count(*) FILTER (last_run IS NULL OR t > last_run) AS DOUBLE) AS new_n, CAST(count(*) FILTER ((last_run IS NULL OR t > last_run) AND win) AS DOUBLE) AS new_k FROM r GROUP BY 1),
w AS (SELECT *, (k + 0) AS kk, {_WILSON} AS oos_lo FROM (SELECT *, CAST(n0 AS DOUBLE) AS n, CAST(k0 AS DOUBLE) AS k FROM g))
SELECT version, data_end, CAST(new_n AS BIGINT) AS new_bets, round(new_k / nullif(new_n, 0), 6) AS live_rate, round(oos_lo, 6) AS oos_lo,
  CASE WHEN last_run IS NOT NULL AND now - last_run < {COOL_MS} THEN 'cooling' WHEN last_run IS NOT NULL AND now - last_run >= {INTERVAL_MS} THEN 'interval' WHEN new_n >= {NEW_BETS} THEN 'new_bets' WHEN new_n >= {LEAST_LIVE} AND new_k / new_n < oos_lo THEN 'live_rate' ELSE 'none' END AS trigger FROM w"""
)
def research_triggers(spark, d):
    """AG13, AG43: data end, new settled bets since the last research, and which trigger fires first outside the cool-down."""
    b = bets(spark, d)
    now = b.agg(F.max("t").alias("now"))
    b = b.withColumn("last_run", _last_run(F.col("version")))
    new, old = F.col("last_run").isNull() | (F.col("t") > F.col("last_run")), F.col("t") < HALF
    g = b.groupBy("version", "last_run").agg(F.max("t").alias("data_end"), F.count_if(old).alias("n0"), F.count_if(old & F.col("win")).alias("k0"), F.count_if(new).alias("n"), F.count_if(new & F.col("win")).alias("k")).join(F.broadcast(now))  # one row
    low, since = stats.wilson_lower(F.col("k0"), F.col("n0")), F.col("now") - F.col("last_run")
    trigger = F.when(since < COOL_MS, "cooling").when(since >= INTERVAL_MS, "interval").when(F.col("n") >= NEW_BETS, "new_bets").when((F.col("n") >= LEAST_LIVE) & (F.col("k") / F.col("n") < low), "live_rate").otherwise("none")
    return g.select("version", "data_end", F.col("n").alias("new_bets"), r6(F.col("k") / F.nullif(F.col("n"), F.lit(0))).alias("live_rate"), r6(low).alias("oos_lo"), trigger.alias("trigger"))


@query(
    f"""WITH {_HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY t DESC, event_id DESC) AS back FROM hits)
SELECT version, CAST(t // 14400000 % 6 AS INTEGER) AS phase, CASE WHEN entry < 0.3 THEN 'low' WHEN entry < 0.6 THEN 'mid' ELSE 'high' END AS price, count(*) AS losers, round(avg(entry), 6) AS mean_entry FROM r WHERE back <= 60 AND NOT win GROUP BY ALL"""
)
def loser_profile(spark, d):
    """AG42: the losers among the newest 60 settled bets of each version (the limit is the feature), by phase of day and price."""
    r = hits(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("version").orderBy(F.desc("t"), F.desc("event_id")))).filter("back <= 60 AND NOT win")
    price = F.when(F.col("entry") < 0.3, "low").when(F.col("entry") < 0.6, "mid").otherwise("high")
    return r.groupBy("version", (F.floor(F.col("t") / 14_400_000) % 6).cast("int").alias("phase"), price.alias("price")).agg(F.count("*").alias("losers"), r6(F.avg("entry")).alias("mean_entry"))


@query(
    f"""WITH {BETS_SQL}, d AS (SELECT version, t // 86400000 AS day, count(*) AS n, avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS rate, avg(entry) AS quote FROM bets GROUP BY 1, 2 HAVING count(*) >= 3),
o AS (SELECT *, rate > quote AS good, row_number() OVER (PARTITION BY version ORDER BY day) - row_number() OVER (PARTITION BY version, rate > quote ORDER BY day) AS island FROM d),
r AS (SELECT version, island, count(*) AS len FROM o WHERE NOT good GROUP BY 1, 2)
SELECT o.version, count(*) AS days, count(*) FILTER (good) AS days_beating, coalesce(any_value(longest), 0) AS longest_losing FROM o LEFT JOIN (SELECT version, max(len) AS longest FROM r GROUP BY 1) m ON o.version = m.version GROUP BY 1"""
)
def daily_stability(spark, d):
    """WF32: days with three bets or more that beat their mean quote, and the longest run of those that do not."""
    g = bets(spark, d).groupBy("version", F.floor(F.col("t") / DAY_MS).alias("day")).agg(F.count("*").alias("n"), F.avg(F.col("win").cast("double")).alias("rate"), F.avg("entry").alias("quote")).filter("n >= 3")
    g = g.withColumn("good", F.col("rate") > F.col("quote"))
    w = Window.partitionBy("version").orderBy("day")
    g = g.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("version", "good").orderBy("day")))
    runs = g.groupBy("version", "good", "island").agg(F.count("*").alias("len"))
    bad = ~F.col("good")
    return runs.groupBy("version").agg(F.sum("len").alias("days"), F.coalesce(F.sum(F.when(F.col("good"), F.col("len"))), F.lit(0)).alias("days_beating"), F.coalesce(F.max(F.when(bad, F.col("len"))), F.lit(0)).alias("longest_losing"))


@query(
    f"""WITH {BETS_SQL}, x AS (SELECT *, version * 1000000 + t // 3600000 AS market, CASE WHEN entry < 0.3 THEN 0 WHEN entry < 0.5 THEN 1 WHEN entry < 0.7 THEN 2 ELSE 3 END AS bucket FROM bets),
m AS (SELECT bucket, market, count(*) AS n, avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS hit, avg(entry) AS quote FROM x GROUP BY 1, 2)
SELECT bucket, count(*) AS markets, CAST(sum(n) AS BIGINT) AS n, round(avg(hit), 6) AS hit_rate, round(avg(quote), 6) AS mean_quote, round(stddev_pop(hit) / sqrt(count(*)), 6) AS se, round(sum(n) * sum(n) / sum(n * n), 4) AS effective_n FROM m GROUP BY 1"""
)
def market_calibration(spark, d):
    """AG25: calibration with one estimate for each market (a version's hour), error over markets, effective number."""
    e = F.col("entry")
    x = bets(spark, d).withColumns({"market": F.floor(F.col("t") / HOUR_MS), "bucket": F.when(e < 0.3, 0).when(e < 0.5, 1).when(e < 0.7, 2).otherwise(3)})
    m = x.groupBy("bucket", "version", "market").agg(F.count("*").alias("n"), F.avg(F.col("win").cast("double")).alias("hit"), F.avg("entry").alias("quote"))
    n = F.sum("n")
    return m.groupBy("bucket").agg(F.count("*").alias("markets"), n.alias("n"), r6(F.avg("hit")).alias("hit_rate"), r6(F.avg("quote")).alias("mean_quote"), r6(F.stddev_pop("hit") / F.sqrt(F.count("*"))).alias("se"), F.round(n * n / F.sum(F.col("n") * F.col("n")), 4).alias("effective_n"))


@query(
    f"""WITH {BETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY round(entry, 6), event_id) AS i, count(*) OVER (PARTITION BY version) AS c FROM bets), c AS (SELECT version, max(round(entry, 6)) FILTER (i = c // 2 + 1) AS cut FROM o GROUP BY 1),
g AS (SELECT b.version, CASE WHEN round(entry, 6) < cut THEN 'below' ELSE 'above' END AS side, any_value(cut) AS cut, count(*) AS n, count(*) FILTER (win) AS k FROM bets b JOIN c USING (version) GROUP BY 1, 2),
m AS (SELECT version, side, cut, n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE)) AS mass FROM g, LATERAL (SELECT unnest(range(n + 1)) AS i))
SELECT version, side, any_value(cut) AS cut, any_value(n) AS n, any_value(k) AS k, round(sum(mass) FILTER (i <= k), 7) AS lower_tail, round(sum(mass) FILTER (i >= k), 7) AS upper_tail FROM m GROUP BY 1, 2"""
)
def median_split(spark, d):
    """AG29, ST7: bets below and from the middle element of a version's entries (not interpolated), with exact binomial tails."""
    b = bets(spark, d).withColumn("e", F.round("entry", 6))
    values = b.groupBy("version", "e").agg(F.count("*").alias("c"))
    w = Window.partitionBy("version").orderBy("e")
    values = values.withColumns({"upto": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(Window.partitionBy("version"))})
    cut = values.filter(F.col("upto") >= F.floor(F.col("all") / 2) + 1).groupBy("version").agg(F.min("e").alias("cut"))
    g = b.join(cut, "version").groupBy("version", F.when(F.col("e") < F.col("cut"), "below").otherwise("above").alias("side"), "cut").agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
    k, n, half = F.col("k"), F.col("n"), F.lit(0.5)
    return g.select("version", "side", "cut", "n", "k", F.round(stats.binomial_lower(k, n, half), 7).alias("lower_tail"), F.round(stats.binomial_lower(n - k, n, half), 7).alias("upper_tail"))


@query(
    f"""WITH {BETS_SQL}, h AS (SELECT unnest([0, 1, 2, 3]) AS hypothesis), x AS (SELECT h.hypothesis, version % 2 AS scene, t // 604800000 AS week, win FROM bets, h WHERE entry >= 0.1 * hypothesis),
w AS (SELECT hypothesis, scene, week, count(*) AS n, count(*) FILTER (win) AS k FROM x GROUP BY 1, 2, 3), g AS (SELECT hypothesis, scene, sum(n) AS n, sum(k) / sum(n) AS p, min(k / n) FILTER (n >= 10) AS worst FROM w GROUP BY 1, 2),
j AS (SELECT g.hypothesis, g.scene, g.n, g.p, g.worst, b.p AS base_p, b.worst AS base_worst, ['3.0', '2.5', '9.0', ''][g.hypothesis + 1] AS note, g.hypothesis IN (0, 3) OR (g.hypothesis = 1 AND g.scene = 0) OR (g.hypothesis = 2 AND g.scene = 1) AS affected FROM g JOIN g b ON b.hypothesis = 0 AND b.scene = g.scene),
v AS (SELECT *, coalesce(nullif(note, '')::DOUBLE, 0) AS claimed, n >= 60 AS g1, NOT affected OR (p - base_p) * 100 >= 2.0 * sqrt(4) AS g2, NOT affected OR coalesce((base_worst - worst) * 100 <= 5, true) AS g3, NOT affected OR 2.8016 * 0.5 / sqrt(n) * 100 <= greatest(coalesce(nullif(note, '')::DOUBLE, 0), 0.1) AS g4 FROM j)
SELECT CAST(hypothesis AS INTEGER) AS hypothesis, CAST(scene AS INTEGER) AS scene, CAST(n AS BIGINT) AS n, round(p, 6) AS p, round((p - base_p) * 100, 4) AS gain_pp, claimed AS claimed_pp, affected, g1, g2, g3, g4, bool_and(g1 AND g2 AND g3 AND g4) OVER (PARTITION BY hypothesis) AS passed FROM v"""
)
def four_gates(spark, d, hypotheses: int = 4):
    """AG34, ST10, ST11, AF36: four hypotheses (entry floors) in two scenes: sample size, gain over the base by base * root of
    the number of hypotheses, worst week, power for the gain claimed in a note; the last three only where a scene is affected."""
    notes = F.array(*map(F.lit, ("base | claimed: 3.0pp", "close | claimed: 2.5pp", "volume | claimed: 9.0pp", "same")))
    b = bets(spark, d).withColumn("hypothesis", F.explode(F.array(*map(F.lit, range(hypotheses))))).filter(F.col("entry") >= F.col("hypothesis") / 10)  # 3 * 0.1 is above 0.3 in doubles, 3 / 10 is not
    w = b.groupBy("hypothesis", (F.col("version") % 2).cast("int").alias("scene"), F.floor(F.col("t") / (7 * DAY_MS)).alias("week")).agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
    g = w.groupBy("hypothesis", "scene").agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("p"), F.min(F.when(F.col("n") >= 10, F.col("k") / F.col("n"))).alias("worst"))
    base = g.filter("hypothesis = 0").select("scene", F.col("p").alias("base_p"), F.col("worst").alias("base_worst"))
    h, scene = F.col("hypothesis"), F.col("scene")
    affected = h.isin(0, 3) | ((h == 1) & (scene == 0)) | ((h == 2) & (scene == 1))
    claim = F.regexp_extract(F.get(notes, h), r"claimed:\s*([\d.]+)pp", 1)
    g = g.join(F.broadcast(base), "scene").withColumns({"affected": affected, "claimed": F.coalesce(F.try_to_number(F.nullif(claim, F.lit("")), F.lit("9.9")).cast("double"), F.lit(0.0))})  # two rows
    free, gain = ~F.col("affected"), (F.col("p") - F.col("base_p")) * 100
    g = g.withColumns({
        "g1": F.col("n") >= 60, "g2": free | (gain >= 2.0 * hypotheses**0.5), "g3": free | F.coalesce((F.col("base_worst") - F.col("worst")) * 100 <= 5, F.lit(True)),
        "g4": free | (stats.minimum_effect(F.col("n")) * 100 <= F.greatest("claimed", F.lit(0.1))),
    })
    passed = F.min(F.col("g1") & F.col("g2") & F.col("g3") & F.col("g4")).over(Window.partitionBy("hypothesis"))
    return g.select("hypothesis", "scene", "n", r6("p").alias("p"), F.round(gain, 4).alias("gain_pp"), F.col("claimed").alias("claimed_pp"), "affected", "g1", "g2", "g3", "g4", passed.alias("passed"))
