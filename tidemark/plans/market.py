"""Queries over samples, bars and cycles: bucketing, rolling frames, streaks, regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, CYCLES_SQL, SAMPLES_SQL

W = src.by_time  # a call gives the window of a series in time order


def r6(c):
    return F.round(c, 6)


@query(f"WITH {SAMPLES_SQL} SELECT event_id, series, t, round(q, 6) AS q, round(pct, 6) AS pct, participants FROM samples WHERE q > 0.02 AND q < 0.98")
def tradable_samples(spark, d):
    """SC6: samples with a quote strictly inside (0.02, 0.98)."""
    s = src.samples(spark, d).filter((F.col("q") > 0.02) & (F.col("q") < 0.98))
    return s.select("event_id", "series", "t", r6("q").alias("q"), r6("pct").alias("pct"), "participants")


@query(f"WITH {BARS_SQL} SELECT series, bar_ts, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 4) AS v, n, outcome FROM bars")
def hourly_bars(spark, d):
    """TB1, TB2, PF1: bars with outcome."""
    return src.bars(spark, d).select("series", "bar_ts", *(r6(x).alias(x) for x in "ohlc"), F.round("v", 4).alias("v"), "n", "outcome")


@query(f"WITH {CYCLES_SQL} SELECT series, cycle_ts, round(o, 6) AS o, round(c, 6) AS c, round(h, 6) AS h, round(l, 6) AS l, round(v, 4) AS v, path FROM cycles")
def complete_cycles(spark, d):
    """TB2, TB4, TB5, WF25: cycles of three bars with their path."""
    return src.cycles(src.bars(spark, d)).select("series", "cycle_ts", *(r6(x).alias(x) for x in "ochl"), F.round("v", 4).alias("v"), "path")


_WILSON = "(CASE WHEN n > 0 THEN greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) ELSE 0 END)"


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, lead(outcome) OVER w AS next_outcome, lead(bar_ts) OVER w AS next_ts FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
g AS (SELECT CAST((bar_ts // 3600000) % 24 AS INTEGER) AS hour_utc, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (next_outcome = outcome) AS DOUBLE) AS k FROM x
  WHERE next_ts - bar_ts = 3600000 AND outcome <> 'NOISE' AND next_outcome <> 'NOISE' GROUP BY 1)
SELECT hour_utc, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round({_WILSON}, 6) AS wilson_lo FROM g"""
)
def hourly_direction_report(spark, d):
    """Flagship (SC, TB2, PF1, WF11, ST2): how often the next adjacent bar repeats the direction, by hour."""
    b = src.bars(spark, d).withColumn("next_outcome", F.lead("outcome").over(W())).withColumn("next_ts", F.lead("bar_ts").over(W()))
    b = b.filter((F.col("next_ts") - F.col("bar_ts") == src.HOUR_MS) & (F.col("outcome") != "NOISE") & (F.col("next_outcome") != "NOISE"))
    g = b.groupBy((F.floor(F.col("bar_ts") / src.HOUR_MS) % 24).cast("int").alias("hour_utc")).agg(F.count("*").alias("n"), F.sum((F.col("outcome") == F.col("next_outcome")).cast("long")).alias("k"))
    return g.select("hour_utc", "n", "k", r6(stats.wilson_lower(F.col("k"), F.col("n"))).alias("wilson_lo"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, bar_ts - lag(bar_ts) OVER (PARTITION BY series ORDER BY bar_ts) AS gap FROM bars)
SELECT series, count(*) AS n_bars, count(*) FILTER (gap = 3600000) AS n_adjacent, CAST(coalesce(sum(round_even(gap / 3600000.0, 0) - 1) FILTER (gap > 5400000), 0) AS BIGINT) AS n_missing, max(gap) AS largest_gap FROM x GROUP BY 1"""
)
def bar_continuity(spark, d):
    """TB3, WF31, AG30: adjacent bars and missing ones, half-even rounding of the gap."""
    b = src.bars(spark, d).withColumn("gap", F.col("bar_ts") - F.lag("bar_ts").over(W()))
    gap = F.col("gap")
    lost = F.when(gap > 1.5 * src.HOUR_MS, F.bround(gap / src.HOUR_MS) - 1)
    return b.groupBy("series").agg(F.count("*").alias("n_bars"), F.count_if(gap == src.HOUR_MS).alias("n_adjacent"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("n_missing"), F.max("gap").alias("largest_gap"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, c,
  count(*) OVER f AS n16, max(h) OVER f AS hi, min(l) OVER f AS lo, avg(c) OVER f AS ma,
  max(c) OVER p AS prior_hi, min(c) OVER p AS prior_lo, count(*) OVER p AS n_prior, v, avg(v) OVER m AS vol_ma, count(*) OVER m AS n_vol FROM bars
  WINDOW f AS (PARTITION BY series ORDER BY bar_ts ROWS 15 PRECEDING), p AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series, bar_ts, CASE WHEN n16 = 16 THEN round(hi, 6) END AS roll_max, CASE WHEN n16 = 16 THEN round(lo, 6) END AS roll_min, CASE WHEN n16 = 16 THEN round(ma, 9) END AS roll_mean,
  CASE WHEN n16 = 16 AND hi > lo THEN round((c - lo) / (hi - lo), 6) END AS pos4h, CASE WHEN n_prior = 48 THEN round(prior_hi, 6) END AS level_hi, CASE WHEN n_prior = 48 THEN round(prior_lo, 6) END AS level_lo,
  CASE WHEN n_vol >= 10 AND vol_ma > 0 THEN round(v / vol_ma, 6) END AS vol_ratio FROM x"""
)
def rolling_levels(spark, d):
    """WF1, WF3, WF5, WF6: rolling extremes and mean, prior levels, volume ratio, position in range."""
    f, p, m = W().rowsBetween(-15, 0), W().rowsBetween(-48, -1), W().rowsBetween(-20, -1)
    b = src.bars(spark, d).withColumns({"n16": F.count("*").over(f), "hi": F.max("h").over(f), "lo": F.min("l").over(f), "ma": F.avg("c").over(f)})
    b = b.withColumns({"prior_hi": F.max("c").over(p), "prior_lo": F.min("c").over(p), "n_prior": F.count("*").over(p), "vol_ma": F.avg("v").over(m), "n_vol": F.count("*").over(m)})
    full, level = F.col("n16") == 16, F.col("n_prior") == 48
    return b.select(
        "series", "bar_ts",
        F.when(full, r6("hi")).alias("roll_max"), F.when(full, r6("lo")).alias("roll_min"), F.when(full, F.round("ma", 9)).alias("roll_mean"),
        F.when(full & (F.col("hi") > F.col("lo")), r6((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("pos4h"),
        F.when(level, r6("prior_hi")).alias("level_hi"), F.when(level, r6("prior_lo")).alias("level_lo"),
        F.when((F.col("n_vol") >= 10) & (F.col("vol_ma") > 0), r6(F.col("v") / F.col("vol_ma"))).alias("vol_ratio"),
    )


def streaks(b, breaks):
    """Length of the run of equal outcomes up to each bar; a run ends where `breaks` holds."""
    b = b.withColumn("run", F.sum(breaks.cast("int")).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    return b.withColumn("streak", F.row_number().over(Window.partitionBy("series", "run").orderBy("bar_ts")))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, CASE WHEN outcome IS DISTINCT FROM lag(outcome) OVER w OR bar_ts - lag(bar_ts) OVER w IS DISTINCT FROM 3600000 THEN 1 ELSE 0 END AS brk FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
y AS (SELECT *, sum(brk) OVER (PARTITION BY series ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT series, bar_ts, outcome, CAST(row_number() OVER (PARTITION BY series, run ORDER BY bar_ts) AS INTEGER) AS streak FROM y"""
)
def outcome_streaks(spark, d):
    """WF7, WF8: streak of equal outcomes that a time gap resets (gaps and islands)."""
    b = src.bars(spark, d)
    same = F.col("outcome").eqNullSafe(F.lag("outcome").over(W())) & (F.col("bar_ts") - F.lag("bar_ts").over(W())).eqNullSafe(F.lit(src.HOUR_MS))
    return streaks(b.withColumn("brk", ~same), F.col("brk")).select("series", "bar_ts", "outcome", "streak")


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, o, h, l, c, sign(c - o) AS dir, lag(o) OVER w AS po, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lead(sign(c - o)) OVER w AS next_dir, lead(bar_ts) OVER w AS next_ts FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts))
SELECT series, bar_ts, CAST(dir AS INTEGER) AS dir, round(po, 6) AS prev_o, round(pc, 6) AS prev_c, CASE WHEN next_ts - bar_ts = 3600000 THEN CAST(next_dir AS INTEGER) END AS next_dir,
  coalesce(h < ph AND l > pl, false) AS inside_bar, coalesce(sign(c - o) * sign(pc - po) < 0 AND abs(c - o) > abs(pc - po), false) AS engulfing, coalesce(h > ph AND c < ph, false) AS sweep_fail FROM x"""
)
def neighbouring_bars(spark, d):
    """WF10, WF11, WF23: previous and next bar, inside, engulfing and failed-sweep flags."""
    b = src.bars(spark, d).withColumn("dir", F.signum(F.col("c") - F.col("o")).cast("int"))
    b = b.withColumns({f"p{x}": F.lag(x).over(W()) for x in "ohlc"} | {"next_dir": F.lead("dir").over(W()), "next_ts": F.lead("bar_ts").over(W())})
    c, body, before = F.col, F.col("c") - F.col("o"), F.col("pc") - F.col("po")
    flag = lambda x, n: F.coalesce(x, F.lit(False)).alias(n)
    return b.select(
        "series", "bar_ts", "dir", r6("po").alias("prev_o"), r6("pc").alias("prev_c"), F.when(c("next_ts") - c("bar_ts") == src.HOUR_MS, c("next_dir")).alias("next_dir"),
        flag((c("h") < c("ph")) & (c("l") > c("pl")), "inside_bar"),
        flag((F.signum(body) * F.signum(before) < 0) & (F.abs(body) > F.abs(before)), "engulfing"),
        flag((c("h") > c("ph")) & (c("c") < c("ph")), "sweep_fail"),
    )


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, abs(ret) AS a, c - lag(c) OVER w AS de FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
y AS (SELECT *, lag(de) OVER (PARTITION BY series ORDER BY bar_ts) AS lag_de FROM x),
z AS (SELECT series, bar_ts, a, quantile_cont(a, 0.5) OVER p AS med, count(a) OVER p AS n, corr(lag_de, de) OVER r AS ac, count(CASE WHEN lag_de IS NOT NULL AND de IS NOT NULL THEN 1 END) OVER r AS pairs FROM y
  WINDOW p AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY series ORDER BY bar_ts ROWS 23 PRECEDING))
SELECT series, bar_ts, CASE WHEN n >= 24 THEN round(med, 6) END AS median_abs_ret, CASE WHEN n >= 24 AND med > 0 THEN round(a / med, 4) END AS vol_state, CASE WHEN pairs >= 16 THEN round(ac, 5) END AS autocorr FROM z"""
)
def rolling_statistics(spark, d):
    """WF17, WF18: rolling median of absolute returns and lag-1 autocorrelation of changes."""
    b = src.bars(spark, d).select("series", "bar_ts", F.abs("ret").alias("a"), (F.col("c") - F.lag("c").over(W())).alias("de"))
    b = b.withColumn("lag_de", F.lag("de").over(W()))
    p, r = W().rowsBetween(-48, -1), W().rowsBetween(-23, 0)
    both = F.col("lag_de").isNotNull() & F.col("de").isNotNull()
    b = b.withColumns({"near": F.sort_array(F.collect_list("a").over(p)), "n": F.count("a").over(p), "ac": stats.correlation(F.col("lag_de"), F.col("de"), lambda agg: agg.over(r)), "pairs": F.count(F.when(both, 1)).over(r)})
    b = b.withColumn("med", F.get(stats.quantiles(F.col("near"), (0.5,)), F.lit(0)))
    enough = F.col("n") >= 24
    return b.select("series", "bar_ts", F.when(enough, r6("med")).alias("median_abs_ret"), F.when(enough & (F.col("med") > 0), F.round(F.col("a") / F.col("med"), 4)).alias("vol_state"), F.when(F.col("pairs") >= 16, F.round("ac", 5)).alias("autocorr"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, c, o, ret, lag(c, 24) OVER w AS c24, lag(o, 24) OVER w AS o24, lag(c, 240) OVER w AS c240, first_value(o) OVER (PARTITION BY series, bar_ts // 14400000 ORDER BY bar_ts) AS open4h, lag(c) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
y AS (SELECT *, sum(abs(c - pc)) OVER r AS way, count(c - pc) OVER r AS steps, stddev_samp(ret) OVER v AS vol, count(ret) OVER v AS n_vol FROM x WINDOW r AS (PARTITION BY series ORDER BY bar_ts ROWS 23 PRECEDING), v AS (PARTITION BY series ORDER BY bar_ts ROWS 239 PRECEDING)),
z AS (SELECT *, CASE WHEN steps = 24 AND way > 0 THEN round(abs(c - c24) / way, 5) END AS eff, CASE WHEN n_vol = 240 THEN vol END AS vol30 FROM y),
q AS (SELECT series, quantile_cont(eff, 0.33) AS e33, quantile_cont(eff, 0.67) AS e67, median(round(vol30, 9)) AS mid FROM z WHERE bar_ts < 1705276800000 GROUP BY 1)
SELECT z.series, bar_ts, CASE WHEN c24 IS NULL THEN NULL WHEN c / c24 - 1 > 0.01 THEN 'BULL' WHEN c / c24 - 1 < -0.01 THEN 'BEAR' ELSE 'FLAT' END AS trend24, CASE WHEN o24 IS NULL THEN NULL WHEN o / o24 - 1 > 0.003 THEN 'BULL' WHEN o / o24 - 1 < -0.003 THEN 'BEAR' ELSE 'FLAT' END AS open_trend,
  round(c - open4h, 6) AS move4h, eff AS efficiency, CASE WHEN eff >= e67 THEN 'trend' WHEN eff <= e33 THEN 'range' WHEN eff IS NOT NULL THEN 'transition' END AS state, CASE WHEN c240 IS NOT NULL THEN c < c240 END AS long_bear, CASE WHEN vol30 IS NOT NULL THEN round(vol30, 9) > mid END AS long_volatile FROM z LEFT JOIN q ON z.series = q.series"""
)
def trend_regimes(spark, d):
    """TB20, TB21, WF20, WF21, WF24: trailing trend of closes (1 %) and of opens (0.3 %), move in the 4-hour bucket,
    efficiency ratio with its state by the discovery part's terciles, long return and volatility flags."""
    four, w = Window.partitionBy("series", F.floor(F.col("bar_ts") / 14_400_000)).orderBy("bar_ts"), W()
    b = src.bars(spark, d).withColumns({"c24": F.lag("c", 24).over(w), "o24": F.lag("o", 24).over(w), "c240": F.lag("c", 240).over(w), "open4h": F.first("o").over(four), "step": F.abs(F.col("c") - F.lag("c").over(w))})
    r, v = w.rowsBetween(-23, 0), w.rowsBetween(-239, 0)
    b = b.withColumns({"way": F.sum("step").over(r), "steps": F.count("step").over(r), "vol": F.stddev_samp("ret").over(v), "n_vol": F.count("ret").over(v)})
    eff = F.when((F.col("steps") == 24) & (F.col("way") > 0), F.round(F.abs(F.col("c") - F.col("c24")) / F.col("way"), 5))
    b = b.withColumns({"eff": eff, "vol30": F.when(F.col("n_vol") == 240, F.round("vol", 9))})
    q = b.filter("bar_ts < 1705276800000").groupBy("series").agg(F.sort_array(F.collect_list("eff")).alias("effs"), F.sort_array(F.collect_list("vol30")).alias("vols"))
    q = q.withColumns({"e": stats.quantiles(F.col("effs"), (0.33, 0.67)), "m": stats.quantiles(F.col("vols"), (0.5,))}).select("series", F.col("e")[0].alias("e33"), F.col("e")[1].alias("e67"), F.col("m")[0].alias("mid"))

    def tag(now, then, least):
        return F.when(then.isNull(), None).when(now / then - 1 > least, "BULL").when(now / then - 1 < -least, "BEAR").otherwise("FLAT")

    e = F.col("eff")
    return b.join(q, "series", "left").select(
        "series", "bar_ts", tag(F.col("c"), F.col("c24"), 0.01).alias("trend24"), tag(F.col("o"), F.col("o24"), 0.003).alias("open_trend"), r6(F.col("c") - F.col("open4h")).alias("move4h"), e.alias("efficiency"),
        F.when(e >= F.col("e67"), "trend").when(e <= F.col("e33"), "range").when(e.isNotNull(), "transition").alias("state"), (F.col("c") < F.col("c240")).alias("long_bear"), (F.col("vol30") > F.col("mid")).alias("long_volatile"),
    )


@query(
    f"""WITH {BARS_SQL} SELECT strftime(make_timestamp(bar_ts * 1000), '%Y-%m') AS month, CAST(isodow(make_timestamp(bar_ts * 1000)) AS INTEGER) AS weekday, CAST((bar_ts // 14400000) % 6 AS INTEGER) AS phase4h,
  count(*) AS n, count(*) FILTER (outcome = 'UP') AS n_up, round(avg(abs(ret)), 6) AS mean_abs_ret FROM bars GROUP BY 1, 2, 3"""
)
def calendar_report(spark, d):
    """TB18, TB19, AG27, AG28: month, weekday and 4-hour phase in UTC."""
    ts = F.timestamp_millis("bar_ts")
    g = src.bars(spark, d).groupBy(F.date_format(ts, "yyyy-MM").alias("month"), (F.weekday(ts) + 1).cast("int").alias("weekday"), (F.floor(F.col("bar_ts") / 14_400_000) % 6).cast("int").alias("phase4h"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "UP").alias("n_up"), r6(F.avg(F.abs("ret"))).alias("mean_abs_ret"))


@query(
    f"""WITH {SAMPLES_SQL}, x AS (SELECT *, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, CAST((t % 3600000) // 300000 AS INTEGER) AS slot FROM samples),
y AS (SELECT *, row_number() OVER (PARTITION BY series, start, slot ORDER BY t, event_id) AS rn FROM x)
SELECT slot, CAST(least(9, floor(q * 10)) AS INTEGER) AS q_bin, count(*) AS n, round(avg(q), 12) AS mean_q FROM y WHERE rn = 1 GROUP BY 1, 2"""
)
def slot_cells(spark, d):
    """TB6, TB7: first sample of each slot, cells of slot and quote bin."""
    s = src.samples(spark, d).withColumns({"start": src.bucket(F.col("t"), src.HOUR_MS), "slot": F.floor((F.col("t") % src.HOUR_MS) / 300_000).cast("int")})
    first = Window.partitionBy("series", "start", "slot").orderBy("t", "event_id")
    s = s.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return s.groupBy("slot", F.least(F.lit(9), F.floor(F.col("q") * 10)).cast("int").alias("q_bin")).agg(F.count("*").alias("n"), F.round(F.avg("q"), 12).alias("mean_q"))
