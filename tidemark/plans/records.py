"""Queries over records: listings and pages, loads and retention, money, paths of signals, alerts, interpolation."""

from __future__ import annotations


from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import asof
from tidemark.plans import detection
from tidemark.plans.evolution import _HITS_SQL, hits
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import W, r6
from tidemark.plans.prediction import CHANNELS, WHOLE_MS, views, views_sql
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.operators.shared import new_path
from tidemark.plans.windows import archived_windows
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, CYCLES_SQL, HOUR_MS, SAMPLES_SQL
from tidemark.streaming.windows import append_new

CYCLE_MS = 3 * HOUR_MS


@query(
    f"""WITH {_HITS_SQL}, g AS (SELECT pattern, count(*) AS n, round(count(*) FILTER (win) / count(*), 6) AS win_rate FROM hits GROUP BY 1), s AS (SELECT *, CASE pattern % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'EVOLVING' ELSE 'RETIRED' END AS status FROM g)
SELECT pattern, status, n, win_rate FROM s ORDER BY CASE status WHEN 'ACTIVE' THEN 0 WHEN 'EVOLVING' THEN 1 ELSE 2 END, win_rate DESC, pattern LIMIT least(greatest(500, 1), 200)"""
)
def ordered_patterns(spark, d, limit: int = 500):
    """PF3, PF6: patterns by status in its own order, then win rate; the page is held to 1 to 200 rows (the limit is the feature)."""
    g = hits(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), r6(F.count_if("win") / F.count("*")).alias("win_rate"))
    g = g.withColumn("status", F.when(F.col("pattern") % 3 == 0, "ACTIVE").when(F.col("pattern") % 3 == 1, "EVOLVING").otherwise("RETIRED"))
    order = F.when(F.col("status") == "ACTIVE", 0).when(F.col("status") == "EVOLVING", 1).otherwise(2)
    return g.orderBy(order, F.desc("win_rate"), "pattern").limit(min(max(limit, 1), 200)).select("pattern", "status", "n", "win_rate")


def listing(spark, d, since: int | None = None, until: int | None = None, outcome: str | None = None, side: str | None = None):
    """PF5: bars under whichever filters are given."""
    b = src.bars(spark, d)
    for given, condition in ((since, F.col("bar_ts") >= since), (until, F.col("bar_ts") < until), (outcome, F.col("outcome") == outcome), (side, F.when(F.lit(side) == "high", F.col("c") >= 0.5).otherwise(F.col("c") < 0.5))):
        if given is not None:
            b = b.filter(condition)
    return b


@query(
    f"""WITH {BARS_SQL} SELECT 'all' AS filters, outcome, count(*) AS n FROM bars GROUP BY 2 UNION ALL SELECT 'since', outcome, count(*) FROM bars WHERE bar_ts >= {HALF} GROUP BY 2
UNION ALL SELECT 'range, outcome', outcome, count(*) FROM bars WHERE bar_ts >= {HALF} AND bar_ts < {HALF + 5 * 86_400_000} AND outcome = 'UP' GROUP BY 2 UNION ALL SELECT 'side', outcome, count(*) FROM bars WHERE c >= 0.5 GROUP BY 2"""
)
def filtered_listings(spark, d):
    """PF5, SC8: the listing with none, some and all of its optional filters."""
    calls = {"all": {}, "since": {"since": HALF}, "range, outcome": {"since": HALF, "until": HALF + 5 * 86_400_000, "outcome": "UP"}, "side": {"side": "high"}}
    out = None
    for name, kw in calls.items():
        g = listing(spark, d, **kw).groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(name).alias("filters"), "outcome", "n")
        out = g if out is None else out.unionByName(g)
    return out


@query(
    f"""WITH {BARS_SQL}, newest AS (SELECT bar_ts, c FROM bars WHERE series = 0 ORDER BY bar_ts DESC LIMIT 50), ahead AS (SELECT bar_ts, c FROM bars WHERE series = 0 AND bar_ts >= {HALF} ORDER BY bar_ts LIMIT 50)
SELECT 'newest' AS page, row_number() OVER (ORDER BY bar_ts) AS place, bar_ts, round(c, 6) AS c FROM newest UNION ALL SELECT 'forward', row_number() OVER (ORDER BY bar_ts), bar_ts, round(c, 6) FROM ahead"""
)
def chart_pages(spark, d, rows: int = 50):
    """PF4: the newest rows in ascending order, and a page forward from a time (both limits are the feature)."""
    b = src.bars(spark, d).filter("series = 0").select("bar_ts", "c")
    pages = b.orderBy(F.desc("bar_ts")).limit(rows).withColumn("page", F.lit("newest")).unionByName(b.filter(F.col("bar_ts") >= HALF).orderBy("bar_ts").limit(rows).withColumn("page", F.lit("forward")))
    return pages.select("page", F.row_number().over(Window.partitionBy("page").orderBy("bar_ts")).cast("long").alias("place"), "bar_ts", r6("c").alias("c"))


@query(
    f"""WITH {BARS_SQL}, s AS (SELECT series, bar_ts, CASE WHEN ret IS NULL OR ret = 0 THEN NULL WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END AS settled FROM bars), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bar_ts DESC) AS place FROM s WHERE settled IS NOT NULL)
SELECT series, bar_ts, settled FROM r WHERE place <= 50"""
)
def learn_windows(spark, d, limit: int = 50):
    """PF2, PF10: the newest windows of each series whose outcome can be settled; no return and a return of 0 cannot (the limit is the feature)."""
    settled = F.when(F.col("ret") > 0, "UP").when(F.col("ret") < 0, "DOWN")
    s = src.bars(spark, d).select("series", "bar_ts", settled.alias("settled")).filter("settled IS NOT NULL")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("bar_ts")))).filter(F.col("place") <= limit).drop("place")


@query(
    """WITH a AS (SELECT o_orderkey, o_orderdate, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS paid, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN '0' WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice * (96 + o_orderkey % 9)) / 100 AS VARCHAR) END AS got FROM orders)
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_filled, count(*) FILTER (TRY_CAST(paid AS DOUBLE) > 0 AND TRY_CAST(got AS DOUBLE) > 0) AS n_settled, round(coalesce(sum(TRY_CAST(got AS DOUBLE) - TRY_CAST(paid AS DOUBLE)) FILTER (TRY_CAST(paid AS DOUBLE) > 0 AND TRY_CAST(got AS DOUBLE) > 0), 0), 2) AS pnl FROM a GROUP BY 1"""
)
def daily_money(spark, d):
    """AG9, AG10: orders, filled ones and profit of each day from amounts kept as text; only where both are above 0 it counts."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    got = F.when(key % 11 == 0, "n/a").when(key % 7 == 0, "0").when(key % 5 == 0, None).otherwise((F.floor(price * (96 + key % 9)) / 100).cast("string"))
    o = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderstatus", price.cast("string").alias("paid"), got.alias("got"))
    o = o.withColumns({"a": F.col("paid").try_cast("double"), "b": F.col("got").try_cast("double")})
    both = F.coalesce((F.col("a") > 0) & (F.col("b") > 0), F.lit(False))
    return o.groupBy("day").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_filled"), F.count_if(both).alias("n_settled"), F.round(F.coalesce(F.sum(F.when(both, F.col("b") - F.col("a"))), F.lit(0.0)), 2).alias("pnl"))


@query(f"""WITH b AS ({ORACLE_SQL["break_events"]}), {SAMPLES_SQL} SELECT b.series, b.cycle_ts, b.side, s.event_id, round((s.t - b.cycle_ts) / 1000.0::DOUBLE, 1) AS offset_s, round(s.q, 6) AS q FROM b JOIN samples s ON s.series = b.series AND s.t >= b.cycle_ts AND s.t < b.cycle_ts + 10800000""")
def signal_paths(spark, d):
    """PF8: the samples of each signal's cycle with their offset from its start in seconds, by an equi-join on the cycle."""
    s = src.samples(spark, d).withColumn("cycle_ts", src.bucket(F.col("t"), CYCLE_MS))
    j = detection.break_events(spark, d).select("series", "cycle_ts", "side").join(s, ["series", "cycle_ts"])
    return j.select("series", "cycle_ts", "side", "event_id", F.round((F.col("t") - F.col("cycle_ts")) / 1000, 1).alias("offset_s"), r6("q").alias("q"))


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT max(t) AS now FROM samples), r AS (SELECT b.*, row_number() OVER (PARTITION BY series ORDER BY bar_ts DESC) AS back FROM bars b, m WHERE bar_ts + 3600000 <= now + 500)
SELECT series, bar_ts, round(c, 6) AS c, row_number() OVER (PARTITION BY series ORDER BY bar_ts) AS place FROM r WHERE back <= 48"""
)
def closed_bars(spark, d, n: int = 48):
    """SC2: the last n closed bars of each series in ascending order; the bar still open is left out."""
    now = src.samples(spark, d).agg(F.max("t").alias("now"))
    b = src.bars(spark, d).join(F.broadcast(now)).filter(F.col("bar_ts") + HOUR_MS <= F.col("now") + 500)  # one row
    b = b.withColumn("back", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("bar_ts")))).filter(F.col("back") <= n)
    return b.select("series", "bar_ts", r6("c").alias("c"), F.row_number().over(W()).cast("long").alias("place"))


@query(
    f"""WITH {BARS_SQL}, s AS (SELECT DISTINCT series, CAST(floor(t / 10800000) * 10800000 AS BIGINT) AS cycle_ts FROM samples)
SELECT s.series, s.cycle_ts, round(coalesce(b.o, 0), 6) AS open_price, CASE WHEN b.o > 0 THEN 'bar' WHEN f.first_q IS NOT NULL THEN 'curve' END AS kind, round(CASE WHEN b.o > 0 THEN b.o ELSE f.first_q END, 6) AS window_open
FROM s LEFT JOIN bars b ON b.series = s.series AND b.bar_ts = s.cycle_ts LEFT JOIN (SELECT series, CAST(floor(t / 10800000) * 10800000 AS BIGINT) AS cycle_ts, arg_min(q, (t, event_id)) FILTER (q > 0.05) AS first_q FROM samples GROUP BY 1, 2) f ON f.series = s.series AND f.cycle_ts = s.cycle_ts"""
)
def boundary_prices(spark, d):
    """SC3, AF38: open of the bar at a cycle's start, 0 where it is missing; the window's open falls back to the first positive point."""
    s = src.samples(spark, d).withColumn("cycle_ts", src.bucket(F.col("t"), CYCLE_MS))
    real = F.col("q") > 0.05
    first = s.groupBy("series", "cycle_ts").agg(F.min_by(F.when(real, F.col("q")), F.when(real, F.struct("t", "event_id"))).alias("first_q"))
    b = src.bars(spark, d).select("series", F.col("bar_ts").alias("cycle_ts"), "o")
    j = first.join(b, ["series", "cycle_ts"], "left")
    has = F.coalesce(F.col("o") > 0, F.lit(False))
    return j.select("series", "cycle_ts", r6(F.coalesce("o", F.lit(0.0))).alias("open_price"), F.when(has, "bar").when(F.col("first_q").isNotNull(), "curve").alias("kind"), r6(F.when(has, F.col("o")).otherwise(F.col("first_q"))).alias("window_open"))


@query(
    f"""WITH {SAMPLES_SQL}, v AS (SELECT series, t, max(q) AS q FROM samples WHERE event_type = 'view' GROUP BY 1, 2), p AS (SELECT event_id, series, t FROM samples WHERE event_type = 'purchase'),
j AS (SELECT p.*, a.t AS t0, a.q AS q0 FROM p ASOF LEFT JOIN v a ON a.series = p.series AND p.t >= a.t), k AS (SELECT j.*, b.t AS t1, b.q AS q1 FROM j ASOF LEFT JOIN v b ON b.series = j.series AND j.t <= b.t)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN q1 WHEN t1 IS NULL OR t1 = t0 THEN q0 ELSE q0 + (q1 - q0) * (t - t0) / (t1 - t0) END, 6) AS price FROM k"""
)
def interpolated_prices(spark, d):
    """JN6: price between the two surrounding views, held at the first and last; it can use the later point."""
    s = src.samples(spark, d)
    v = s.filter("event_type = 'view'").groupBy("series", "t").agg(F.max("q").alias("q")).withColumn("p", F.struct("t", "q"))
    p = s.filter("event_type = 'purchase'").select("event_id", "series", "t")
    one = asof.as_of(p, v, "series", "t", "p", "a")
    # the next point is the last one in reversed time
    back = asof.as_of(one.withColumn("t", -F.col("t")), v.withColumn("t", -F.col("t")), "series", "t", "p", "b").withColumn("t", -F.col("t"))
    t0, q0, t1, q1 = F.col("a.t"), F.col("a.q"), F.col("b.t"), F.col("b.q")
    price = F.when(t0.isNull(), q1).when(t1.isNull() | (t1 == t0), q0).otherwise(q0 + (q1 - q0) * (F.col("t") - t0) / (t1 - t0))
    return back.select("event_id", r6(price).alias("price"))


@query(
    f"""WITH {BARS_SQL}, w AS (SELECT series, CAST(floor(t / 10800000) * 10800000 AS BIGINT) AS start, count(*) FILTER (event_type = 'view') AS views, list(round(q, 6) ORDER BY t, event_id) FILTER (event_type = 'view') AS own FROM samples GROUP BY 1, 2),
c AS (SELECT series, CAST(floor(bar_ts / 10800000) * 10800000 AS BIGINT) AS start, list(round(c, 6) ORDER BY bar_ts) AS closes FROM bars GROUP BY 1, 2)
SELECT w.series, w.start, views = 0 AS backfilled, CAST(len(CASE WHEN views = 0 THEN closes ELSE own END) AS INTEGER) AS points, array_to_string(CASE WHEN views = 0 THEN closes ELSE own END, ',') AS curve FROM w JOIN c ON w.series = c.series AND w.start = c.start WHERE views = 0"""
)
def backfilled_curves(spark, d):
    """SC10: cycles without a view get their curve from the closes of the bars inside them."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), CYCLE_MS))
    w = s.groupBy("series", "start").agg(F.count_if(F.col("event_type") == "view").alias("views")).filter("views = 0")
    b = src.bars(spark, d).withColumn("start", src.bucket(F.col("bar_ts"), CYCLE_MS)).join(w, ["series", "start"])
    curve = F.transform(F.array_sort(F.collect_list(F.struct("bar_ts", r6("c").alias("c")))), lambda x: x["c"])  # at most three bars
    g = b.groupBy("series", "start").agg(curve.alias("curve"))
    return g.select("series", "start", F.lit(True).alias("backfilled"), F.size("curve").alias("points"), F.array_join(F.col("curve").cast("array<string>"), ",").alias("curve"))


@query(
    f"""WITH {BARS_SQL}, u AS (SELECT 0 AS part, series, bar_ts, c, v FROM bars WHERE bar_ts < {HALF} UNION ALL SELECT 1, series, bar_ts, c, v + 1 FROM bars WHERE bar_ts >= {HALF - 86_400_000}), r AS (SELECT *, row_number() OVER (PARTITION BY series, bar_ts ORDER BY part DESC) AS rn FROM u)
SELECT series, bar_ts, round(c, 6) AS c, round(v, 4) AS v FROM r WHERE rn = 1"""
)
def merged_bars(spark, d):
    """SC11: cached bars and those fetched anew with a day of overlap: one row for each open time, the later load wins."""
    b = src.bars(spark, d).select("series", "bar_ts", "c", "v")
    both = b.filter(F.col("bar_ts") < HALF).withColumn("part", F.lit(0)).unionByName(b.filter(F.col("bar_ts") >= HALF - 86_400_000).withColumn("v", F.col("v") + 1).withColumn("part", F.lit(1)))
    g = both.groupBy("series", "bar_ts").agg(F.max_by(F.struct("c", "v"), "part").alias("x"))
    return g.select("series", "bar_ts", r6("x.c").alias("c"), F.round("x.v", 4).alias("v"))


@query(
    f"""WITH {SAMPLES_SQL}, m AS (SELECT max(t) AS now FROM samples) SELECT event_type, count(*) FILTER (t >= now - CASE WHEN event_type = 'error' THEN 10 * 86400000 ELSE 240 * 3600000 END) AS kept, count(*) FILTER (t < now - CASE WHEN event_type = 'error' THEN 10 * 86400000 ELSE 240 * 3600000 END) AS removed FROM samples, m GROUP BY 1"""
)
def retained_samples(spark, d, sample_hours: int = 240, health_days: int = 10):
    """SC14, SC15: what retention of samples by hours and of health rows by days keeps; the kept rows are written by type anew."""
    root = new_path(spark, "retained")
    s = src.samples(spark, d)
    now = s.agg(F.max("t").alias("now"))
    age = F.when(F.col("event_type") == "error", health_days * 86_400_000).otherwise(sample_hours * HOUR_MS)
    marked = s.join(F.broadcast(now)).withColumn("keep", F.col("t") >= F.col("now") - age)  # one row
    marked.filter("keep").drop("now", "keep").write.partitionBy("event_type").parquet(root)
    kept = spark.read.parquet(root).groupBy("event_type").agg(F.count("*").alias("kept"))
    all_ = s.groupBy("event_type").agg(F.count("*").alias("n"))
    return all_.join(kept, "event_type", "left").select("event_type", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


@query(f"WITH a AS ({ORACLE_SQL['archived_windows']}) SELECT series, start, sample_count, entry, outcome FROM a")
def loaded_windows(spark, d):
    """SC7: windows written as lines of JSON and loaded with a fixed schema; a line that does not fit it fails the load."""
    root = new_path(spark, "windows")
    archived_windows(spark, d).select(F.to_json(F.struct("series", "start", "sample_count", "entry", "outcome")).alias("value")).write.text(root)
    return spark.read.schema("series long, start long, sample_count long, entry double, outcome string").json(root, mode="FAILFAST")


@query(f"WITH a AS ({ORACLE_SQL['archived_windows']}) SELECT series, start, sample_count, outcome FROM a")
def sunk_windows(spark, d):
    """SC9, SC12, SC13, TS14: overlapping and repeated batches into a sink that appends only new keys, partitioned by day."""
    root = new_path(spark, "sink")
    a = archived_windows(spark, d).select("series", "start", "sample_count", "outcome", F.floor(F.col("start") / 86_400_000).alias("day"))
    write = append_new(root, ["series", "start"], "day")
    write(a.filter(F.col("start") < HALF), 0)
    write(a.filter(F.col("start") >= HALF - 5 * 86_400_000), 1)
    write(a.filter(F.col("start") >= HALF - 5 * 86_400_000), 1)  # the batch again, as after a failure
    return spark.read.parquet(root).select("series", "start", "sample_count", "outcome")


@query(
    f"""WITH {CYCLES_SQL}, x AS (SELECT *, c > o AS up, lag(cycle_ts) OVER w AS pts, lag(c > o) OVER w AS pup FROM cycles WINDOW w AS (PARTITION BY series ORDER BY cycle_ts)),
y AS (SELECT *, sum(CASE WHEN up IS DISTINCT FROM pup OR cycle_ts - pts IS DISTINCT FROM 10800000 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY cycle_ts ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT series, min(cycle_ts) AS first_cycle, any_value(up) AS up, count(*) AS cycles, round(sum(v), 4) AS v FROM y GROUP BY series, run"""
)
def run_blocks(spark, d):
    """Adjacent cycles of one direction merged into runs (`run_block_intervals` draws runs of hits)."""
    w = Window.partitionBy("series").orderBy("cycle_ts")
    x = src.cycles(src.bars(spark, d)).withColumn("up", F.col("c") > F.col("o"))
    new = ~(F.col("up").eqNullSafe(F.lag("up").over(w)) & (F.col("cycle_ts") - F.lag("cycle_ts").over(w)).eqNullSafe(F.lit(CYCLE_MS)))
    x = x.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("series", "run").agg(F.min("cycle_ts").alias("first_cycle"), F.first("up").alias("up"), F.count("*").alias("cycles"), F.round(F.sum("v"), 4).alias("v")).drop("run")


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, c, CASE WHEN n >= 3 THEN v END AS v, abs(q_end - c) > 0.1 AS wrong FROM (SELECT b.*, lag(c) OVER (PARTITION BY series ORDER BY bar_ts) AS q_end FROM bars b)),
y AS (SELECT *, avg(v) OVER w20 AS nan_mean, count(v) OVER w20 AS n_mean, avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) OVER w48 AS rate, count(wrong) OVER w48 AS n_wrong, max(c) OVER w48 AS hi, min(c) OVER w48 AS lo, count(c) OVER w48 AS n_c FROM x
  WINDOW w20 AS (PARTITION BY series ORDER BY bar_ts ROWS 19 PRECEDING), w48 AS (PARTITION BY series ORDER BY bar_ts ROWS 47 PRECEDING)),
z AS (SELECT *, CASE WHEN n_c >= 24 AND hi > lo THEN (c - lo) / (hi - lo) END AS pos FROM y)
SELECT series, bar_ts, round(nan_mean, 7) AS nan_mean, CASE WHEN n_wrong >= 24 THEN round(rate, 6) END AS mispriced, CASE WHEN n_c >= 24 THEN round(hi, 6) END AS level_hi, round(pos, 6) AS position, CASE WHEN pos < 0.3333 THEN 'low' WHEN pos < 0.6667 THEN 'mid' WHEN pos IS NOT NULL THEN 'high' END AS place FROM z"""
)
def tolerant_levels(spark, d):
    """WF2, WF4, WF19, WF37: a rolling mean that ignores missing values, a rolling rate of mispriced bars, and levels and positions
    that need only half of their 48 rows."""
    w20, w48 = W().rowsBetween(-19, 0), W().rowsBetween(-47, 0)
    b = src.bars(spark, d).withColumns({"v": F.when(F.col("n") >= 3, F.col("v")), "wrong": F.abs(F.lag("c").over(W()) - F.col("c")) > 0.1})
    b = b.withColumns({"nan_mean": F.avg("v").over(w20), "rate": F.avg(F.coalesce("wrong", F.lit(False)).cast("double")).over(w48), "n_wrong": F.count("wrong").over(w48), "hi": F.max("c").over(w48), "lo": F.min("c").over(w48), "n_c": F.count("c").over(w48)})
    half = F.col("n_c") >= 24
    b = b.withColumn("pos", F.when(half & (F.col("hi") > F.col("lo")), (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    place = F.when(F.col("pos") < 0.3333, "low").when(F.col("pos") < 0.6667, "mid").when(F.col("pos").isNotNull(), "high")
    return b.select("series", "bar_ts", F.round("nan_mean", 7).alias("nan_mean"), F.when(F.col("n_wrong") >= 24, r6("rate")).alias("mispriced"), F.when(half, r6("hi")).alias("level_hi"), r6("pos").alias("position"), place.alias("place"))


@query(
    f"""WITH {CYCLES_SQL}, c AS (SELECT series, bar_ts, c, v, lag(c) OVER w AS pc, lag(v) OVER w AS pv, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4 FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
m AS (SELECT *, sign(v - pv) AS side FROM c WHERE abs(v / nullif(pv, 0) - 1) >= 0.5), u AS (SELECT side, unnest([0, 1, 2, 3, 4]) AS step, unnest([c - pc, c1 - pc, c2 - pc, c3 - pc, c4 - pc]) AS dq FROM m)
SELECT CAST(step AS INTEGER) AS step, count(dq) AS n, round(avg(side * dq), 6) AS aligned FROM u GROUP BY 1"""
)
def latency_cascade(spark, d):
    """WF35: how quotes move, in its direction, 0 to 4 bars after a large change of volume."""
    b = src.bars(spark, d).withColumns({"pc": F.lag("c").over(W()), "pv": F.lag("v").over(W())} | {f"c{k}": F.lead("c", k).over(W()) for k in range(1, 5)})
    m = b.filter(F.abs(F.col("v") / F.nullif(F.col("pv"), F.lit(0.0)) - 1) >= 0.5).withColumn("side", F.signum(F.col("v") - F.col("pv")))
    moves = F.array(F.col("c") - F.col("pc"), *(F.col(f"c{k}") - F.col("pc") for k in range(1, 5)))
    return m.select("side", F.posexplode(moves).alias("step", "dq")).groupBy("step").agg(F.count("dq").alias("n"), r6(F.avg(F.col("side") * F.col("dq"))).alias("aligned"))


@query(
    f"""WITH {BARS_SQL}, q AS (SELECT series, quantile_cont(round(h - l, 9), [0.333, 0.667]) AS cuts FROM bars GROUP BY 1), x AS (SELECT b.series, CASE WHEN round(h - l, 9) <= cuts[1] THEN 'low' WHEN round(h - l, 9) <= cuts[2] THEN 'mid' ELSE 'high' END AS tercile, outcome, h - l AS amp FROM bars b JOIN q ON b.series = q.series)
SELECT series, tercile, count(*) AS n, count(*) FILTER (outcome = 'UP') AS n_up, round(avg(amp), 6) AS mean_amplitude FROM x GROUP BY 1, 2"""
)
def volatility_terciles(spark, d):
    """AG38: bars by terciles of their amplitude."""
    b = src.bars(spark, d).withColumn("amp", F.round(F.col("h") - F.col("l"), 9))
    q = b.groupBy("series").agg(F.sort_array(F.collect_list("amp")).alias("all")).select("series", stats.quantiles(F.col("all"), (0.333, 0.667)).alias("cuts"))
    t = F.when(F.col("amp") <= F.get("cuts", F.lit(0)), "low").when(F.col("amp") <= F.get("cuts", F.lit(1)), "mid").otherwise("high")
    return b.join(q, "series").groupBy("series", t.alias("tercile")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "UP").alias("n_up"), r6(F.avg(F.col("h") - F.col("l"))).alias("mean_amplitude"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS version, o_orderdate AS day, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS link FROM orders), s AS (SELECT o_custkey AS version, o_orderdate AS day, max(o_orderkey) AS signal FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2)
SELECT o.id, coalesce(o.link, s.signal) AS signal, o.link IS NULL AND s.signal IS NOT NULL AS filled_in FROM o LEFT JOIN s ON o.version = s.version AND o.day = s.day"""
)
def linked_orders(spark, d):
    """JN18: orders without a signal take that of the same version and day."""
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("version"), F.col("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("link"))
    s = o.filter("link IS NOT NULL").groupBy("version", "day").agg(F.max("link").alias("signal"))
    return o.join(s, ["version", "day"], "left").select("id", F.coalesce("link", "signal").alias("signal"), (F.col("link").isNull() & F.col("signal").isNotNull()).alias("filled_in"))


@query(
    f"""WITH {_HITS_SQL}, a AS (SELECT pattern, version, CASE WHEN entry >= 0.5 THEN 'high' ELSE 'low' END AS side, CASE WHEN t < {HALF} THEN 'settled' WHEN win THEN 'open' END AS status FROM hits), b AS (SELECT series AS version, outcome AS side FROM (WITH {BARS_SQL} SELECT series, outcome FROM bars))
SELECT 'signal' AS family, version, side, status, count(*) AS n, count(DISTINCT pattern) AS patterns FROM a WHERE status IS NULL OR status NOT IN ('open') GROUP BY ALL UNION ALL SELECT 'window', version, side, NULL, count(*), 0 FROM b GROUP BY ALL"""
)
def signal_counts(spark, d):
    """AG44, PF7, SO1: signals counted by version, side and status, those with an open status left out, together with windows as a second family."""
    a = hits(spark, d).select("pattern", "version", F.when(F.col("entry") >= 0.5, "high").otherwise("low").alias("side"), F.when(F.col("t") < HALF, "settled").when(F.col("win"), "open").alias("status"))
    a = a.filter(F.col("status").isNull() | ~F.col("status").isin("open")).withColumn("family", F.lit("signal"))
    b = src.bars(spark, d).select(F.col("series").alias("version"), F.col("outcome").alias("side")).withColumn("family", F.lit("window"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("family", "version", "side", "status").agg(F.count("*").alias("n"), F.countDistinct("pattern").alias("patterns"))


@query("SELECT version, min(place) AS place, bool_or(known) AS known FROM (SELECT unnest(['1-URGENT', '3-MEDIUM', '9-NEW']) AS version, unnest([0, 1, 2]) AS place, true AS known UNION ALL SELECT DISTINCT o_orderpriority, 9, false FROM orders) GROUP BY 1")
def known_versions(spark, d):
    """SO2: known versions in their own order, then those observed besides."""
    known = spark.createDataFrame([("1-URGENT", 0, True), ("3-MEDIUM", 1, True), ("9-NEW", 2, True)], "version string, place int, known boolean")
    seen = src.table(spark, d, "orders").select(F.col("o_orderpriority").alias("version")).distinct().select("version", F.lit(9).alias("place"), F.lit(False).alias("known"))
    return known.unionByName(seen).groupBy("version").agg(F.min("place").alias("place"), F.max("known").alias("known"))


def _stride(total: Column, k: Column, j: Column) -> Column:
    """TB12: place j of k taken evenly from `total`, rounded half to even; the middle one for k = 1."""
    return F.when(k == 1, F.floor(total / 2)).otherwise(F.bround(j * (total - 1) / (k - 1))).cast("long")


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT series, bar_ts, row_number() OVER (PARTITION BY series ORDER BY bar_ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS m FROM bars), k AS (SELECT unnest([1, 7, 20]) AS k),
p AS (SELECT DISTINCT series, k, CASE WHEN k = 1 THEN CAST(floor(m / 2) AS BIGINT) ELSE CAST(round_even(j * (m - 1) / (k - 1.0::DOUBLE), 0) AS BIGINT) END AS i FROM (SELECT DISTINCT series, m FROM r), k, LATERAL (SELECT unnest(range(k)) AS j))
SELECT r.series, CAST(p.k AS INTEGER) AS k, r.bar_ts FROM r JOIN p ON r.series = p.series AND r.i = p.i"""
)
def uniform_samples(spark, d):
    """TB12: 1, 7 and 20 rows of each series at even places (half to even, no place twice, the middle one alone)."""
    w = Window.partitionBy("series")
    r = src.bars(spark, d).select("series", "bar_ts", (F.row_number().over(w.orderBy("bar_ts")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("m"))
    sizes = r.select("series", "m").distinct().withColumn("k", F.explode(F.array(*map(F.lit, (1, 7, 20)))))
    p = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("series", "k", _stride(F.col("m"), F.col("k"), F.col("j")).alias("i")).distinct()
    return r.join(p, ["series", "i"]).select("series", "k", "bar_ts")


@query(
    f"""WITH {BARS_SQL}, g AS (SELECT series, outcome, count(*) AS m, sum(count(*)) OVER (PARTITION BY series) AS total FROM bars GROUP BY 1, 2), q AS (SELECT *, greatest(1, CAST(floor(25 * m / total) AS BIGINT)) AS quota FROM g), z AS (SELECT *, sum(quota) OVER (PARTITION BY series) AS given, row_number() OVER (PARTITION BY series ORDER BY quota DESC, outcome) AS big FROM q),
f AS (SELECT *, CAST(CASE WHEN big = 1 THEN quota - greatest(given - 25, 0) ELSE quota END AS BIGINT) AS k FROM z), r AS (SELECT b.series, b.bar_ts, b.outcome, abs(b.ret) AS a, row_number() OVER (PARTITION BY b.series, b.outcome ORDER BY abs(b.ret) DESC, b.bar_ts) - 1 AS i, f.m, f.k FROM bars b JOIN f ON b.series = f.series AND b.outcome = f.outcome),
p AS (SELECT * FROM r WHERE i IN (SELECT unnest(list_transform(range(k), lambda j: CAST(floor(j * m / k) AS BIGINT)))))
SELECT series, outcome, count(*) AS picked, any_value(m) AS available, round(avg(a), 6) AS mean_size, round(max(a), 6) AS max_size FROM p GROUP BY 1, 2"""
)
def quota_summary(spark, d, target: int = 25):
    """TB14: quotas of a target by outcome (floor, at least 1, the largest gives way), filled at strides by size of return, with summaries."""
    w = Window.partitionBy("series")
    q = src.bars(spark, d).groupBy("series", "outcome").agg(F.count("*").alias("m"))
    q = q.withColumn("quota", F.greatest(F.lit(1), F.floor(target * F.col("m") / F.sum("m").over(w))))
    q = q.withColumns({"given": F.sum("quota").over(w), "big": F.row_number().over(w.orderBy(F.desc("quota"), "outcome"))})
    q = q.withColumn("k", F.when(F.col("big") == 1, F.col("quota") - F.greatest(F.col("given") - target, F.lit(0))).otherwise(F.col("quota"))).select("series", "outcome", "m", "k")
    r = src.bars(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("series", "outcome").orderBy(F.desc(F.abs("ret")), "bar_ts")) - 1)
    picks = q.withColumn("i", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.floor(j * F.col("m") / F.col("k")))))
    p = r.join(picks, ["series", "outcome", "i"])
    return p.groupBy("series", "outcome").agg(F.count("*").alias("picked"), F.first("m").alias("available"), r6(F.avg(F.abs("ret"))).alias("mean_size"), r6(F.max(F.abs("ret"))).alias("max_size"))


@query(
    f"""WITH {SAMPLES_SQL}, x AS (SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, t, event_id, pct FROM samples), o AS (SELECT *, row_number() OVER (PARTITION BY series, start ORDER BY t, event_id) AS i FROM x)
SELECT series, start, count(*) AS kept, round(arg_max(pct, i), 6) AS decision_pct, count(*) FILTER (t - start > 900000) AS kept_late FROM o WHERE t - start <= 900000 OR i <= 2 GROUP BY 1, 2"""
)
def bench_truncation(spark, d):
    """TB10: windows cut at a decision point, of which the first two points stay in any case."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), HOUR_MS))
    late = F.col("t") - F.col("start") > 900_000
    o = s.withColumn("i", F.row_number().over(Window.partitionBy("series", "start").orderBy("t", "event_id"))).filter(~late | (F.col("i") <= 2))
    return o.groupBy("series", "start").agg(F.count("*").alias("kept"), r6(F.max_by("pct", "i")).alias("decision_pct"), F.count_if(late).alias("kept_late"))


@query(
    f"""WITH {CYCLES_SQL}, n AS (SELECT series, cycle_ts, lead(cycle_ts) OVER w AS nts, lead(o) OVER w AS no, lead(c) OVER w AS nc FROM cycles WINDOW w AS (PARTITION BY series ORDER BY cycle_ts))
SELECT n.series, n.cycle_ts, nc < no AS next_down, round(a.c / no - 1, 6) AS z5, round(b.c / no - 1, 6) AS z10 FROM n LEFT JOIN bars a ON a.series = n.series AND a.bar_ts = nts LEFT JOIN bars b ON b.series = n.series AND b.bar_ts = nts + 3600000 WHERE nts - cycle_ts = 10800000"""
)
def next_cycles(spark, d):
    """WF12: whether the next cycle falls, and where its first and second bar close against its opening."""
    b = src.bars(spark, d)
    w = Window.partitionBy("series").orderBy("cycle_ts")
    inner = b.withColumn("cycle_ts", src.bucket(F.col("bar_ts"), CYCLE_MS)).groupBy("series", "cycle_ts").agg(*(F.max(F.when(F.col("bar_ts") == F.col("cycle_ts") + k * HOUR_MS, F.col("c"))).alias(f"c{k}") for k in (0, 1)))
    c = src.cycles(b).join(inner, ["series", "cycle_ts"])
    n = c.select("series", "cycle_ts", *(F.lead(x).over(w).alias(f"n_{x}") for x in ("cycle_ts", "o", "c", "c0", "c1"))).filter(F.col("n_cycle_ts") - F.col("cycle_ts") == CYCLE_MS)
    return n.select("series", "cycle_ts", (F.col("n_c") < F.col("n_o")).alias("next_down"), r6(F.col("n_c0") / F.col("n_o") - 1).alias("z5"), r6(F.col("n_c1") / F.col("n_o") - 1).alias("z10"))


@query("""SELECT fingerprint, count(*) AS parts, min(p_partkey) AS first_part FROM (SELECT p_partkey, lower(trim(p_brand)) || '|' || lower(trim(coalesce(p_type, ''))) || '|' || CAST(p_size // 10 AS VARCHAR) AS fingerprint FROM part) GROUP BY 1""")
def fingerprints(spark, d):
    """AF33: a pattern's fingerprint from its trimmed, lower-cased fields, missing ones empty, and the first that bears it."""
    mark = F.concat_ws("|", F.lower(F.trim("p_brand")), F.lower(F.trim(F.coalesce("p_type", F.lit("")))), F.floor(F.col("p_size") / 10).cast("string"))
    return src.table(spark, d, "part").groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query(f"WITH {views_sql(WHOLE_MS)}, l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY start DESC) AS back FROM views) SELECT series, start, m, {', '.join(f'{c}_{s}' for c in CHANNELS for s in ('flat', 'rise'))}, {', '.join(f'{c}_peaks' for c in CHANNELS)} FROM l WHERE back = 1")
def current_views(spark, d):
    """DP37: the newest window of each series, whole or not, as the three-channel view that a prediction reads."""
    v = views(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("start")))).filter("back = 1")
    return v.select("series", "start", "m", *(f"{c}_{s}" for c in CHANNELS for s in ("flat", "rise")), *(f"{c}_peaks" for c in CHANNELS))
