"""Queries with joins: as-of, interval, tolerance, adjacency, baseline pool, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans.market import W, r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, HOUR_MS, SAMPLES_SQL


@query(
    f"""WITH {SAMPLES_SQL}, a AS (SELECT event_id, series, t FROM samples WHERE event_type = 'purchase'), b AS (SELECT series, t, q, event_id FROM samples WHERE event_type = 'view')
SELECT a.event_id, a.series, a.t, round(b.q, 6) AS last_view_q FROM a ASOF LEFT JOIN b ON a.series = b.series AND a.t >= b.t"""
)
def last_view_before_purchase(spark, d):
    """JN5: as-of join of two event streams."""
    s = src.samples(spark, d)
    got = asof.as_of(s.filter("event_type = 'purchase'").select("event_id", "series", "t"), s.filter("event_type = 'view'").select("series", "t", "q"), "series", "t", "q", "last_view_q")
    return got.select("event_id", "series", "t", r6("last_view_q").alias("last_view_q"))


@query(
    f"""WITH {SAMPLES_SQL}, p AS (SELECT event_id, series, CASE WHEN event_id % 40 = 0 THEN t // 3600000 * 3600000 ELSE t END AS t, CASE WHEN volume > 50 THEN 'UP' WHEN volume > 25 THEN 'DOWN' ELSE 'NO_TRADE' END AS direction FROM samples WHERE event_type = 'click'), {BARS_SQL[len(SAMPLES_SQL) + 2 :]}
SELECT p.event_id, p.direction, max(b.bar_ts) AS window_start, arg_max(b.outcome, b.bar_ts) AS outcome, count(*) AS n_covering, CASE WHEN p.direction = 'NO_TRADE' THEN coalesce(arg_max(b.outcome, b.bar_ts) = 'NOISE', false) ELSE coalesce(p.direction = arg_max(b.outcome, b.bar_ts), false) END AS is_correct
FROM p JOIN bars b ON p.series = b.series AND p.t BETWEEN b.bar_ts AND b.bar_ts + 3600000 GROUP BY p.event_id, p.direction"""
)
def validated_predictions(spark, d):
    """JN1, JN3, JN4, PF11, DP18: the windows that cover each prediction, both ends included, by an equi-join
    on its bucket and, at a boundary, the one before; the one that ends last decides whether it was right."""
    s = src.samples(spark, d).filter("event_type = 'click'")
    t = F.when(F.col("event_id") % 40 == 0, src.bucket(F.col("t"), HOUR_MS)).otherwise(F.col("t"))  # some at the very boundary
    p = s.select("event_id", "series", t.alias("t"), F.when(F.col("volume") > 50, "UP").when(F.col("volume") > 25, "DOWN").otherwise("NO_TRADE").alias("direction"))
    at = src.bucket(F.col("t"), HOUR_MS)
    p = p.withColumn("bar_ts", F.explode(F.when(F.col("t") == at, F.array(at, at - HOUR_MS)).otherwise(F.array(at))))
    j = p.join(src.bars(spark, d).select("series", "bar_ts", "outcome"), ["series", "bar_ts"])
    j = j.groupBy("event_id", "direction").agg(F.max("bar_ts").alias("window_start"), F.max_by("outcome", "bar_ts").alias("outcome"), F.count("*").alias("n_covering"))
    right = F.when(F.col("direction") == "NO_TRADE", F.col("outcome") == "NOISE").otherwise(F.col("direction") == F.col("outcome"))
    return j.select("event_id", "direction", "window_start", "outcome", "n_covering", F.coalesce(right, F.lit(False)).alias("is_correct"))


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT a.series, a.bar_ts, b.c AS past, row_number() OVER (PARTITION BY a.series, a.bar_ts ORDER BY b.bar_ts DESC) AS rn FROM bars a JOIN bars b ON a.series = b.series AND b.bar_ts BETWEEN a.bar_ts - 14400000 - 3600000 AND a.bar_ts - 14400000 + 3600000)
SELECT a.series, a.bar_ts, round((a.c / m.past - 1) * 100, 5) AS chg_pct FROM bars a LEFT JOIN m ON a.series = m.series AND a.bar_ts = m.bar_ts AND m.rn = 1"""
)
def change_over_four_hours(spark, d):
    """JN7: tolerance join with the latest bar near four hours ago."""
    b = src.bars(spark, d).select("series", "bar_ts", "c")
    got = asof.nearest_within(b, b, "series", "bar_ts", F.col("bar_ts") - 4 * HOUR_MS, HOUR_MS, "c", "past", ["series", "bar_ts"])
    return got.select("series", "bar_ts", F.round((F.col("c") / F.col("past") - 1) * 100, 5).alias("chg_pct"))


@query(
    f"""WITH {BARS_SQL}, h AS (SELECT series, bar_ts FROM bars WHERE ret > 2)
SELECT b.series, count(*) AS pool, count(*) FILTER (outcome = 'UP') AS pool_up FROM bars b WHERE EXISTS (SELECT 1 FROM h WHERE h.series = b.series AND b.bar_ts BETWEEN h.bar_ts - 10800000 AND h.bar_ts + 10800000)
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.series = b.series AND h.bar_ts = b.bar_ts) GROUP BY 1"""
)
def local_baseline_pool(spark, d):
    """JN12, SO3: windows within three hours of any hit, without the hits, by merged hit intervals."""
    b = src.bars(spark, d)
    hits = b.filter("ret > 2").select("series", "bar_ts")
    span = asof.merged_intervals(hits, "bar_ts", 3 * HOUR_MS)
    hours = span.select("series", F.explode(F.sequence("lo", "hi", F.lit(HOUR_MS))).alias("bar_ts"))
    pool = b.join(hours, ["series", "bar_ts"], "left_semi").join(hits, ["series", "bar_ts"], "left_anti")
    return pool.groupBy("series").agg(F.count("*").alias("pool"), F.count_if(F.col("outcome") == "UP").alias("pool_up"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, outcome, lead(bar_ts) OVER w AS n1, lead(outcome) OVER w AS o1, lead(bar_ts, 2) OVER w AS n2, lead(outcome, 2) OVER w AS o2 FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts))
SELECT outcome, CASE WHEN n1 - bar_ts = 3600000 THEN o1 END AS next_outcome, CASE WHEN n2 - bar_ts = 7200000 THEN o2 END AS second_outcome, count(*) AS n FROM x GROUP BY ALL"""
)
def adjacent_windows(spark, d):
    """JN8, JN9: next and second-next window with exact adjacency."""
    b = src.bars(spark, d)
    for k in (1, 2):
        b = b.withColumn(f"o{k}", F.when(F.lead("bar_ts", k).over(W()) - F.col("bar_ts") == k * HOUR_MS, F.lead("outcome", k).over(W())))
    return b.groupBy("outcome", F.col("o1").alias("next_outcome"), F.col("o2").alias("second_outcome")).agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT o_custkey AS version, o_orderkey AS id, o_orderdate AS day, o_totalprice AS amount FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY day DESC, id DESC) AS rn FROM o),
top AS (SELECT version, count(*) AS n_recent, round(avg(amount), 7) AS recent_mean FROM r WHERE rn <= 10 GROUP BY 1)
SELECT c.c_custkey AS version, r.id AS latest_id, coalesce(t.n_recent, 0) AS n_recent, t.recent_mean FROM customer c LEFT JOIN r ON r.version = c.c_custkey AND r.rn = 1 LEFT JOIN top t ON t.version = c.c_custkey"""
)
def latest_runs(spark, d):
    """JN2, JN13, WF26, WF27: latest row and the ten most recent of each key, left joined with a default."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = src.table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    g = r.groupBy(F.col("o_custkey").alias("version")).agg(F.max(F.when(F.col("rn") == 1, F.col("o_orderkey"))).alias("latest_id"), F.count("*").alias("n_recent"), F.round(F.avg("o_totalprice"), 7).alias("recent_mean"))
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("version"))
    return c.join(g, "version", "left").select("version", "latest_id", F.coalesce("n_recent", F.lit(0)).alias("n_recent"), "recent_mean")
