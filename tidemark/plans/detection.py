"""Queries of detectors: break events, shadow triggers with settlement, quote boxes, gates, candle classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import curves, ev
from tidemark.plans.market import W, r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, CURVES_SQL, HOUR_MS


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, max(c) OVER p AS hi, min(c) OVER p AS lo, count(*) OVER p AS k FROM bars WINDOW p AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
s AS (SELECT series, bar_ts, 'high' AS side, hi AS level, c, h, l FROM x WHERE k = 24 AND h > hi * 1.0005 UNION ALL SELECT series, bar_ts, 'low', lo, c, h, l FROM x WHERE k = 24 AND l < lo * 0.9995),
r AS (SELECT *, CAST(floor(bar_ts / 10800000) * 10800000 AS BIGINT) AS cycle_ts, row_number() OVER (PARTITION BY series, floor(bar_ts / 10800000), side ORDER BY bar_ts) AS rn FROM s)
SELECT series, cycle_ts, side, bar_ts, round(level, 6) AS level, (side = 'high' AND c < level) OR (side = 'low' AND c > level) AS fake FROM r WHERE rn = 1"""
)
def break_events(spark, d):
    """DP1, DP5, WF3, WF22: the first break of a prior level in each cycle and side, and whether it failed."""
    p = W().rowsBetween(-24, -1)
    x = src.bars(spark, d).withColumns({"hi": F.max("c").over(p), "lo": F.min("c").over(p), "k": F.count("*").over(p)}).filter("k = 24")
    sides = F.array(
        F.struct(F.lit("high").alias("side"), F.col("hi").alias("level"), (F.col("h") > F.col("hi") * 1.0005).alias("broke"), (F.col("c") < F.col("hi")).alias("fake")),
        F.struct(F.lit("low").alias("side"), F.col("lo").alias("level"), (F.col("l") < F.col("lo") * 0.9995).alias("broke"), (F.col("c") > F.col("lo")).alias("fake")),
    )
    s = x.withColumn("cycle_ts", src.bucket(F.col("bar_ts"), 3 * HOUR_MS)).withColumn("s", F.explode(F.filter(sides, lambda e: e["broke"])))
    first = Window.partitionBy("series", "cycle_ts", "s.side").orderBy("bar_ts")
    s = s.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return s.select("series", "cycle_ts", "s.side", "bar_ts", r6("s.level").alias("level"), "s.fake")


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, outcome, c, lag(c) OVER w AS pc, lag(bar_ts) OVER w AS pts, lead(bar_ts) OVER w AS nts, lead(outcome) OVER w AS no, lead(o) OVER w AS nq, max(bar_ts) OVER (PARTITION BY series) AS last FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
t AS (SELECT *, CASE WHEN pts = bar_ts - 3600000 AND abs(c / pc - 1) < 0.5 THEN 'v2' ELSE 'v1' END AS version FROM x WHERE outcome = 'UP' AND c <= 0.4)
SELECT series, bar_ts AS window_start, version, CASE WHEN nts - bar_ts = 3600000 THEN 'SETTLED' WHEN last - bar_ts > 3600000 THEN 'EXPIRED' ELSE 'PENDING' END AS status,
  CASE WHEN nts - bar_ts = 3600000 THEN no = 'DOWN' END AS win, CASE WHEN nts - bar_ts = 3600000 THEN round(CASE WHEN no = 'DOWN' THEN 0.98 / least(greatest(1 - nq + 0.01, 0.01), 0.99) - 1 ELSE -1 END, 6) END AS ev_at_entry FROM t"""
)
def shadow_signals(spark, d):
    """DP2, DP3, EV3, TS12: UP windows that end low bet DOWN on the next window; settled, pending or expired."""
    x = src.bars(spark, d).withColumns({"pc": F.lag("c").over(W()), "pts": F.lag("bar_ts").over(W()), "nts": F.lead("bar_ts").over(W()), "no": F.lead("outcome").over(W()), "nq": F.lead("o").over(W()), "last": F.max("bar_ts").over(Window.partitionBy("series"))})
    t = x.filter((F.col("outcome") == "UP") & (F.col("c") <= 0.4))
    calm = F.coalesce((F.col("pts") == F.col("bar_ts") - HOUR_MS) & (F.abs(F.col("c") / F.col("pc") - 1) < 0.5), F.lit(False))
    settled = F.coalesce(F.col("nts") - F.col("bar_ts") == HOUR_MS, F.lit(False))
    win = F.when(settled, F.col("no") == "DOWN")
    return t.select(
        "series", F.col("bar_ts").alias("window_start"), F.when(calm, "v2").otherwise("v1").alias("version"),
        F.when(settled, "SETTLED").when(F.col("last") - F.col("bar_ts") > HOUR_MS, "EXPIRED").otherwise("PENDING").alias("status"), win.alias("win"), r6(ev.realised(win, 1 - F.col("nq"))).alias("ev_at_entry"),
    )


# Rules of the quote boxes: version, minutes [lo, hi), percent [lo, hi), direction.
RULES = (("momentum", 30, 45, 69.0, 75.0, "UP"), ("contrarian", 15, 30, 15.0, 25.0, "UP"), ("momentum_wide", 20, 50, 60.0, 80.0, "UP"), ("contrarian_wide", 10, 40, 10.0, 30.0, "UP"))
_RULES_SQL = ", ".join(f"('{v}', {a * 60000}, {b * 60000}, {lo}, {hi}, '{s}')" for v, a, b, lo, hi, s in RULES)


@query(
    f"""WITH {CURVES_SQL}, p AS (SELECT series, start, v[-1] AS y1, v[1] AS y0, unnest(v) AS y, unnest(ts) AS t, unnest(range(len(v))) AS i FROM curves), r(version, a, b, lo, hi, side) AS (VALUES {_RULES_SQL}),
h AS (SELECT p.*, r.version, row_number() OVER (PARTITION BY series, start, version ORDER BY i) AS rn FROM p JOIN r ON p.t - p.start >= a AND p.t - p.start < b AND p.y >= lo AND p.y < hi)
SELECT series, start, version, round(y, 6) AS quote, CASE WHEN y1 > y0 THEN 'UP' WHEN y1 < y0 THEN 'DOWN' ELSE 'NOISE' END AS outcome, round(CASE WHEN y1 > y0 THEN 0.98 / (y / 100) - 1 ELSE -1 END, 6) AS pnl FROM h WHERE rn = 1"""
)
def quote_edges(spark, d):
    """DP4, AF40, EV4, EV11, EV12, TS11: the first hit of each rule's box in a window, settled in the same window."""
    w = src.curves(spark, d)
    hits = F.array(*(F.struct(F.lit(v).alias("version"), curves.first_hit(F.col("curve"), F.col("start"), a * 60_000, b * 60_000, lo, hi)["v"].alias("quote")) for v, a, b, lo, hi, _ in RULES))
    move = F.get("v", F.size("v") - 1) - F.get("v", F.lit(0))
    w = w.select("series", "start", src.outcome(move).alias("outcome"), F.explode(F.filter(hits, lambda h: h["quote"].isNotNull())).alias("h"))
    return w.select("series", "start", "h.version", r6("h.quote").alias("quote"), "outcome", r6(ev.realised_plain(F.col("outcome") == "UP", F.col("h.quote") / 100)).alias("pnl"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, avg(v) OVER m AS ma, count(*) OVER m AS k, sign(c - o) AS dir, lag(sign(c - o)) OVER w AS d1, lag(sign(c - o), 2) OVER w AS d2 FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts), m AS (PARTITION BY series ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
f AS (SELECT series, bar_ts, CASE WHEN h > l THEN (c - l) / (h - l) END AS cp, CASE WHEN k >= 10 AND ma > 0 THEN v / ma END AS vr, dir > 0 AND d1 > 0 AND d2 > 0 AS three_up FROM x)
SELECT series, bar_ts, round(cp, 6) AS close_pos, round(vr, 6) AS vol_ratio, CASE WHEN cp >= 0.85 AND vr >= 2 THEN 'bull_exhaust' WHEN cp <= 0.15 AND vr >= 2 THEN 'bear_exhaust' WHEN three_up AND cp >= 0.85 THEN 'momentum_fade' ELSE 'none' END AS pattern FROM f"""
)
def candle_patterns(spark, d):
    """AF28, AF29, AF30: close position, volume ratio and pattern precedence."""
    m = W().rowsBetween(-20, -1)
    sgn = F.signum(F.col("c") - F.col("o"))
    x = src.bars(spark, d).withColumns({"ma": F.avg("v").over(m), "k": F.count("*").over(m), "d0": sgn, "d1": F.lag(sgn).over(W()), "d2": F.lag(sgn, 2).over(W())})
    cp = F.when(F.col("h") > F.col("l"), (F.col("c") - F.col("l")) / (F.col("h") - F.col("l")))
    vr = F.when((F.col("k") >= 10) & (F.col("ma") > 0), F.col("v") / F.col("ma"))
    x = x.withColumns({"cp": cp, "vr": vr, "up3": (F.col("d0") > 0) & (F.col("d1") > 0) & (F.col("d2") > 0)})
    loud = F.col("vr") >= 2
    name = F.when((F.col("cp") >= 0.85) & loud, "bull_exhaust").when((F.col("cp") <= 0.15) & loud, "bear_exhaust").when(F.col("up3") & (F.col("cp") >= 0.85), "momentum_fade").otherwise("none")
    return x.select("series", "bar_ts", r6("cp").alias("close_pos"), r6("vr").alias("vol_ratio"), name.alias("pattern"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'switched_off' WHEN o_orderpriority LIKE '5%' THEN 'no_direction' WHEN o_totalprice / 500000 <= 0.2 THEN 'low_confidence' WHEN o_orderkey % 10 < 2 THEN 'few_samples' ELSE 'ok' END AS reason,
  NOT (o_orderstatus = 'P' OR o_orderpriority LIKE '5%' OR o_totalprice / 500000 <= 0.2 OR o_orderkey % 10 < 2) AS passed FROM orders"""
)
def gate_reasons(spark, d):
    """Ordered rules of which the first failure names the reason, over orders (`trade_gate` has the full gate)."""
    o = src.table(spark, d, "orders")
    reason = F.when(F.col("o_orderstatus") == "P", "switched_off").when(F.col("o_orderpriority").startswith("5"), "no_direction").when(F.col("o_totalprice") / 500000 <= 0.2, "low_confidence").when(F.col("o_orderkey") % 10 < 2, "few_samples").otherwise("ok")
    return o.select(F.col("o_orderkey").alias("id"), reason.alias("reason")).withColumn("passed", F.col("reason") == "ok")


@query(
    f"""WITH {BARS_SQL}, g AS (SELECT series, CAST(bar_ts // 86400000 AS BIGINT) AS day, list_sort(list(DISTINCT bar_ts)) AS ids FROM bars GROUP BY 1, 2)
SELECT series, day, CAST(len(ids) AS INTEGER) AS n, substr(sha256(array_to_string(ids, ',')), 1, 16) AS token FROM g"""
)
def snapshot_tokens(spark, d):
    """AF35, SO4: a stable token of a set of windows."""
    g = src.bars(spark, d).groupBy("series", F.floor(F.col("bar_ts") / 86_400_000).alias("day")).agg(F.array_sort(F.collect_set("bar_ts")).alias("ids"))
    return g.select("series", "day", F.size("ids").alias("n"), F.substring(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256), 1, 16).alias("token"))


@query("SELECT o_orderpriority AS version, count(*) AS n, count(DISTINCT o_custkey) AS n_keys FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F') GROUP BY 1")
def official_versions(spark, d):
    """PF7: rows whose status is null or not a shadow one, counted by version."""
    o = src.table(spark, d, "orders").filter(F.col("o_orderstatus").isNull() | ~F.col("o_orderstatus").isin("F"))
    return o.groupBy(F.col("o_orderpriority").alias("version")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_keys"))


@query("SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def newest_listing(spark, d):
    """PF9, WF34: a filter, an order and a bounded page (the limit is the feature)."""
    o = src.table(spark, d, "orders").filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderstatus") == "O"))
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
