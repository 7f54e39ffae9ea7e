"""Queries of price surfaces and of patterns' lives: variance ratio, retirement, change log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.accounting import BETS_SQL, bets
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL

# The bins of z, the knots between which prices are interpolated, rows that a cell needs.
Z_EDGES = (-4.0, -2.0, -1.0, -0.33, 0.33, 1.0, 2.0, 4.0)
KNOTS = (-4.8, -3.0, -1.5, -0.665, 0.665, 1.5, 3.0, 4.4)
CELL = 15
#: Start of the second half of the events, in ms.
HALF = 1_705_276_800_000


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, ret, row_number() OVER w AS i, count(ret) OVER (PARTITION BY series) AS n, avg(ret) OVER (PARTITION BY series) AS mu, sum(ret) OVER (w ROWS 3 PRECEDING) AS s, lag(ret, 1) OVER w AS r1, lag(ret, 2) OVER w AS r2, lag(ret, 3) OVER w AS r3
  FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
g AS (SELECT series, any_value(n)::DOUBLE AS n, var_samp(ret) AS v1, sum((s - 4 * mu) * (s - 4 * mu)) FILTER (i >= 4) AS vq, sum((ret - mu) * (ret - mu)) AS d0, sum((ret - mu) * (r1 - mu)) AS d1, sum((ret - mu) * (r2 - mu)) AS d2, sum((ret - mu) * (r3 - mu)) AS d3 FROM x GROUP BY 1),
h AS (SELECT *, CASE WHEN n >= 16 AND v1 > 0 THEN vq / (4 * (n - 3) * (1 - 4 / n)) / v1 END AS vr, 2.25 * (d1 / nullif(d0, 0)) * (d1 / nullif(d0, 0)) + (d2 / nullif(d0, 0)) * (d2 / nullif(d0, 0)) + 0.25 * (d3 / nullif(d0, 0)) * (d3 / nullif(d0, 0)) AS theta FROM g)
SELECT series, CAST(n AS BIGINT) AS n, round(vr, 4) AS vr, round(sqrt(n * 4) * (vr - 1) / sqrt(2 * 3 * 7 / 12.0::DOUBLE), 3) AS z_ref, CASE WHEN theta > 0 THEN round(sqrt(n) * (vr - 1) / sqrt(theta), 3) END AS z_star_ref FROM h"""
)
def variance_ratios(spark, d, q: int = 4):
    """ST12: variance ratio over q bars of each series, with both scores; null below 4q bars."""
    w, whole = src.by_time(), Window.partitionBy("series")
    x = src.bars(spark, d).withColumns({"i": F.row_number().over(w), "n": F.count("ret").over(whole), "mu": F.avg("ret").over(whole), "s": F.sum("ret").over(w.rowsBetween(1 - q, 0))})
    x = x.withColumns({f"r{k}": F.lag("ret", k).over(w) for k in range(1, q)})
    off = F.col("ret") - F.col("mu")
    excess = F.col("s") - q * F.col("mu")
    g = x.groupBy("series").agg(
        F.first("n").cast("double").alias("n"), F.var_samp("ret").alias("v1"), F.sum(F.when(F.col("i") >= q, excess * excess)).alias("vq"), F.sum(off * off).alias("d0"),
        *(F.sum(off * (F.col(f"r{k}") - F.col("mu"))).alias(f"d{k}") for k in range(1, q)),
    )
    n = F.col("n")
    vr = F.when((n >= 4 * q) & (F.col("v1") > 0), F.col("vq") / (q * (n - q + 1) * (1 - q / n)) / F.col("v1"))
    theta = F.lit(0.0)
    for k in range(1, q):
        share = F.col(f"d{k}") / F.nullif(F.col("d0"), F.lit(0.0))
        theta = theta + (2 * (q - k) / q) ** 2 * share * share
    g = g.withColumns({"vr": vr, "theta": theta})
    z = F.sqrt(n * q) * (F.col("vr") - 1) / (2 * (q - 1) * (2 * q - 1) / (3 * q)) ** 0.5
    return g.select("series", n.cast("long").alias("n"), F.round("vr", 4).alias("vr"), F.round(z, 3).alias("z_ref"), F.when(F.col("theta") > 0, F.round(F.sqrt(n) * (F.col("vr") - 1) / F.sqrt("theta"), 3)).alias("z_star_ref"))


_PATTERNS_SQL = BETS_SQL + ", pats AS (SELECT version % 4 * 24 + CAST(t // 3600000 % 24 AS BIGINT) AS id, count(*) AS n, count(*) FILTER (win) / count(*) AS win_rate, count(*) FILTER (t >= 1705276800000 AND win) / nullif(count(*) FILTER (t >= 1705276800000), 0) AS recent FROM bets GROUP BY 1)"


def patterns(b):
    """Bets by version (of four) and hour: a catalogue of 96 patterns, with all-time and recent win rate."""
    new = F.col("t") >= HALF
    g = b.groupBy((F.col("version") % 4 * 24 + F.floor(F.col("t") / 3_600_000) % 24).alias("id")).agg(F.count("*").alias("n"), F.count_if("win").alias("k"), F.count_if(new).alias("n_new"), F.count_if(new & F.col("win")).alias("k_new"))
    return g.select("id", "n", (F.col("k") / F.col("n")).alias("win_rate"), (F.col("k_new") / F.nullif(F.col("n_new"), F.lit(0))).alias("recent"))


@query(
    f"""WITH {_PATTERNS_SQL}, c AS (SELECT count(*) AS active FROM pats), s AS (SELECT id, n, round(0.6 * win_rate + 0.4 * coalesce(recent, win_rate), 9) AS score FROM pats WHERE n > 5),
r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS place FROM s) SELECT id, n, score, place FROM r, c WHERE active >= 3 AND place <= active - 30"""
)
def retired_patterns(spark, d, cap: int = 30, least: int = 5):
    """WF28: the worst of the patterns over the cap, among those with enough samples."""
    p = patterns(bets(spark, d))
    active = p.agg(F.count("*").alias("active"))
    s = p.filter(F.col("n") > least).select("id", "n", F.round(0.6 * F.col("win_rate") + 0.4 * F.coalesce("recent", "win_rate"), 9).alias("score"))
    # one row for each pattern: the catalogue, not the data, is ranked
    s = s.withColumn("place", F.row_number().over(Window.orderBy("score", "id")).cast("long"))
    return s.join(F.broadcast(active)).filter((F.col("active") >= 3) & (F.col("place") <= F.col("active") - cap)).drop("active")


@query(
    f"""WITH {BETS_SQL}, o AS (SELECT version % 4 * 24 + CAST(t // 3600000 % 24 AS BIGINT) AS id, count(*) AS n, count(*) FILTER (win) AS k FROM bets WHERE t < 1705276800000 GROUP BY 1), w AS (SELECT version % 4 * 24 + CAST(t // 3600000 % 24 AS BIGINT) AS id, count(*) AS n, count(*) FILTER (win) AS k FROM bets WHERE t >= 1705276800000 GROUP BY 1)
SELECT id, CASE WHEN o.n IS NULL THEN 'CREATE' WHEN w.n IS NULL THEN 'RETIRE' ELSE 'UPDATE' END AS change, CASE WHEN o.n IS NOT NULL THEN '{{"n":' || o.n || ',"k":' || o.k || '}}' END AS before, CASE WHEN w.n IS NOT NULL THEN '{{"n":' || w.n || ',"k":' || w.k || '}}' END AS after
FROM o FULL JOIN w USING (id) WHERE o.n IS DISTINCT FROM w.n OR o.k IS DISTINCT FROM w.k"""
)
def pattern_changes(spark, d):
    """DP34: one row with both snapshots for each pattern that was created, updated or retired."""
    b = bets(spark, d)

    def snapshot(rows, name):
        g = rows.groupBy((F.col("version") % 4 * 24 + F.floor(F.col("t") / 3_600_000) % 24).alias("id")).agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
        return g.select("id", F.to_json(F.struct("n", "k")).alias(name))

    both = snapshot(b.filter(F.col("t") < HALF), "before").join(snapshot(b.filter(F.col("t") >= HALF), "after"), "id", "full")
    change = F.when(F.col("before").isNull(), "CREATE").when(F.col("after").isNull(), "RETIRE").otherwise("UPDATE")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("id", change.alias("change"), "before", "after")


_ZBIN = "CASE " + " ".join(f"WHEN z < {e} THEN {k}" for k, e in enumerate(Z_EDGES[:-1])) + " ELSE 7 END"
_TILES_SQL = f"""{BARS_SQL}, sg AS (SELECT round(stddev_pop(ret) FILTER (ret <> 0), 9) AS sigma FROM bars),
quotes AS (SELECT s.event_id, s.series, b.bar_ts, s.q, b.o, b.outcome, 1 - (s.t - b.bar_ts) / 3600000.0::DOUBLE AS tau FROM samples s JOIN bars b ON s.series = b.series AND CAST(floor(s.t / 3600000) * 3600000 AS BIGINT) = b.bar_ts),
zs AS (SELECT event_id, series, bar_ts, 1 - q AS down, outcome, CASE WHEN tau < 0.5 THEN 0 ELSE 1 END AS half, round((q / o - 1) / (sigma * sqrt(tau)), 9) AS z FROM quotes, sg WHERE tau > 0.03),
tiles AS (SELECT *, {_ZBIN} AS zbin FROM zs),
surf AS (SELECT half, zbin, median(round(down, 6)) AS price, count(DISTINCT (series, bar_ts)) FILTER (outcome <> 'NOISE') AS n, count(DISTINCT (series, bar_ts)) FILTER (outcome = 'DOWN') AS n_down FROM tiles GROUP BY 1, 2
  HAVING count(*) >= 15 AND count(DISTINCT (series, bar_ts)) FILTER (outcome <> 'NOISE') >= 15)"""


def tiles(spark, d):
    """Samples with their half of the window and their distance from its open in deviations."""
    b = src.bars(spark, d)
    sigma = b.agg(F.round(F.stddev_pop(F.when(F.col("ret") != 0, F.col("ret"))), 9).alias("sigma"))
    s = src.samples(spark, d).withColumn("bar_ts", src.bucket(F.col("t"), src.HOUR_MS)).join(b.select("series", "bar_ts", "o", "outcome"), ["series", "bar_ts"])
    s = s.withColumn("tau", 1 - (F.col("t") - F.col("bar_ts")) / src.HOUR_MS).filter("tau > 0.03").join(F.broadcast(sigma))  # one row
    z = F.round((F.col("q") / F.col("o") - 1) / (F.nullif(F.col("sigma"), F.lit(0.0)) * F.sqrt("tau")), 9)
    s = s.select("event_id", "series", "bar_ts", (1 - F.col("q")).alias("down"), "outcome", F.when(F.col("tau") < 0.5, 0).otherwise(1).alias("half"), z.alias("z"))
    return s.withColumn("zbin", F.expr(_ZBIN))


def surface(t):
    """AG35: median price and share of windows that fell, by half and bin; cells need 15 of each."""
    of_window = t.groupBy("half", "zbin", "series", "bar_ts").agg(F.first("outcome").alias("outcome"))
    cycles = of_window.groupBy("half", "zbin").agg(F.count_if(F.col("outcome") != "NOISE").alias("n"), F.count_if(F.col("outcome") == "DOWN").alias("n_down"))
    # counts of values first: a cell's task gets at most a million distinct prices
    values = t.groupBy("half", "zbin", F.round("down", 6).alias("down")).agg(F.count("*").alias("k"))
    prices = values.groupBy("half", "zbin").agg(F.percentile("down", 0.5, F.col("k")).alias("price"), F.sum("k").alias("m"))
    return prices.join(cycles, ["half", "zbin"]).filter((F.col("m") >= CELL) & (F.col("n") >= CELL))


@query(f"WITH {_TILES_SQL} SELECT half, zbin, round(price, 6) AS price, round(n_down / n, 6) AS freq, n FROM surf")
def price_surface(spark, d):
    """AG35, AG37, AF27: the surface of DOWN prices over time left and distance from the open."""
    return surface(tiles(spark, d)).select("half", "zbin", r6("price").alias("price"), r6(F.col("n_down") / F.col("n")).alias("freq"), "n")


@query(
    f"""WITH {_TILES_SQL}, k AS (SELECT half, price AS y, [{', '.join(map(str, KNOTS))}][zbin + 1]::DOUBLE AS x FROM surf),
lo AS (SELECT event_id, max(x) AS x0 FROM tiles t JOIN k ON t.half = k.half AND k.x <= t.z GROUP BY 1), hi AS (SELECT event_id, min(x) AS x1 FROM tiles t JOIN k ON t.half = k.half AND k.x > t.z GROUP BY 1)
SELECT t.event_id, round(CASE WHEN x0 IS NULL AND x1 IS NULL THEN 0.5 WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (t.z - x0) / (x1 - x0) END, 6) AS fair_down, round(t.down, 6) AS down
FROM tiles t LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id) LEFT JOIN k a ON a.half = t.half AND a.x = x0 LEFT JOIN k b ON b.half = t.half AND b.x = x1"""
)
def surface_prices(spark, d):
    """EV14: DOWN price of every sample between the surface's knots; flat outside, one half without any."""
    t = tiles(spark, d)
    x = F.element_at(F.array(*map(F.lit, KNOTS)), F.col("zbin") + 1)
    knots = surface(t).groupBy("half").agg(F.array_sort(F.collect_list(F.struct(x.alias("x"), F.col("price").alias("y")))).alias("knots"))
    t = t.join(F.broadcast(knots), "half", "left")  # two rows
    below = F.filter("knots", lambda k: k["x"] <= F.col("z"))
    a, b = F.get(below, F.size(below) - 1), F.get(F.filter("knots", lambda k: k["x"] > F.col("z")), F.lit(0))
    between = a["y"] + (b["y"] - a["y"]) * (F.col("z") - a["x"]) / (b["x"] - a["x"])
    return t.select("event_id", r6(F.coalesce(between, a["y"], b["y"], F.lit(0.5))).alias("fair_down"), r6("down").alias("down"))
