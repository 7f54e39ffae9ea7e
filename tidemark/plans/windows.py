"""Queries over curve windows: archive, truncation, curve kernels, symbols, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import curves as k
from tidemark.functions import stats
from tidemark.operators.predicates import compile_predicate
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import CURVES_SQL

# A curve's points as rows, numbered from 0.
POINTS_SQL = CURVES_SQL + ", pts AS (SELECT series, start, len(v) AS n, unnest(v) AS y, unnest(ts) AS t, unnest(range(len(v))) AS i FROM curves)"


@query(
    f"""WITH {CURVES_SQL} SELECT series, start, sample_count, round(mean_participants, 6) AS mean_participants, round(mean_volume, 6) AS mean_volume, round(v[1], 6) AS entry, round(v[-1], 6) AS exit,
  CASE WHEN v[-1] > v[1] THEN 'UP' WHEN v[-1] < v[1] THEN 'DOWN' ELSE 'NOISE' END AS outcome FROM curves"""
)
def archived_windows(spark, d):
    """TB1, TS4: one archived window per series and bucket."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), src.HOUR_MS))
    at, first, last = F.struct("t", "event_id"), F.col("entry"), F.col("exit")
    w = s.groupBy("series", "start").agg(F.min_by("pct", at).alias("entry"), F.max_by("pct", at).alias("exit"), F.count("*").alias("sample_count"), F.avg("participants").alias("people"), F.avg("volume").alias("mean"))
    return w.select("series", "start", "sample_count", r6("people").alias("mean_participants"), r6("mean").alias("mean_volume"), r6(first).alias("entry"), r6(last).alias("exit"), src.outcome(last - first).alias("outcome"))


@query(
    f"""WITH {POINTS_SQL}, x AS (SELECT *, y - lag(y) OVER w AS dl, lag(y) OVER w AS py, lead(y) OVER w AS ny, y - min(y) OVER w AS up, max(y) OVER w - y AS down FROM pts WINDOW w AS (PARTITION BY series, start ORDER BY i)),
g AS (SELECT series, start, max(n) AS n, arg_min(y, i) AS y0, arg_max(y, i) AS y1, avg(y) AS m, coalesce(sum(abs(dl)), 0) AS way, max(up) AS run_up, max(down) AS drawdown, count(*) FILTER ((y > py AND y > ny) OR (y < py AND y < ny)) AS n_extrema FROM x GROUP BY 1, 2),
h AS (SELECT p.series, p.start, sum(greatest(p.y - (g.y0 + (g.y1 - g.y0) / greatest(p.n - 1, 1) * p.i), 0)) AS above, sum(abs(p.y - (g.y0 + (g.y1 - g.y0) / greatest(p.n - 1, 1) * p.i))) AS off,
  sum((p.i / greatest(p.n - 1, 1) - 0.5) * (p.y - g.m)) / nullif(sum((p.i / greatest(p.n - 1, 1) - 0.5) * (p.i / greatest(p.n - 1, 1) - 0.5)), 0) AS slope FROM pts p JOIN g USING (series, start) GROUP BY 1, 2)
SELECT series, start, CAST(n AS INTEGER) AS n, CAST(n_extrema AS INTEGER) AS n_extrema, round(run_up, 5) AS run_up, round(drawdown, 5) AS drawdown, CASE WHEN n >= 2 THEN round(slope, 4) ELSE 0 END AS slope,
  CASE WHEN n >= 2 AND off > 1e-9 THEN round(above / off, 5) ELSE 0.5 END AS area_ratio, round(way, 5) AS way FROM g JOIN h USING (series, start)"""
)
def curve_kernels(spark, d):
    """AF1, AF2, AF7, AF8, AF18, AF25, WF16: numeric kernels of each curve."""
    v = F.col("v")
    w = src.curves(spark, d)
    n = F.size(v)
    step = (F.get(v, n - 1) - F.get(v, F.lit(0))) / F.greatest(n - 1, F.lit(1))
    off = k.total(F.transform(v, lambda x, i: F.abs(x - (F.get(v, F.lit(0)) + step * i))))
    return w.select(
        "series", "start", n.alias("n"), F.size(k.extrema(v)).alias("n_extrema"), F.round(k.run_up(v), 5).alias("run_up"), F.round(k.drawdown(v), 5).alias("drawdown"),
        F.round(k.slope(v), 4).alias("slope"), F.when((n >= 2) & (off > 1e-9), F.round(k.area_ratio(v), 5)).otherwise(0.5).alias("area_ratio"), F.round(k.total(F.transform(k.deltas(v), F.abs)), 5).alias("way"),
    )


@query(
    f"""WITH {POINTS_SQL}, f AS (SELECT series, start, min(t) AS t0 FROM pts GROUP BY 1, 2)
SELECT p.series, p.start, CAST(count(*) FILTER (p.t - f.t0 <= 1800000) AS INTEGER) AS kept, round(arg_max(p.y, p.i) FILTER (p.t - f.t0 <= 1800000), 6) AS decision_pct, round(arg_max(p.y, p.i), 6) AS end_pct,
  round(arg_min(p.y, p.i) FILTER (p.y >= 15 AND p.y < 25 AND p.t - p.start >= 600000 AND p.t - p.start < 2400000), 6) AS hit_pct,
  arg_min(p.t - p.start, p.i) FILTER (p.y >= 15 AND p.y < 25 AND p.t - p.start >= 600000 AND p.t - p.start < 2400000) AS hit_ms FROM pts p JOIN f USING (series, start) GROUP BY 1, 2"""
)
def decision_points(spark, d):
    """TB9, AF39, AF40: truncation at a decision point, last value, first hit in a box (`cell_events` has it with its context)."""
    w = src.curves(spark, d)
    kept = F.filter("curve", lambda p: p["t"] - F.get("curve", F.lit(0))["t"] <= 1_800_000)
    hit = k.first_hit(F.col("curve"), F.col("start"), 600_000, 2_400_000, 15.0, 25.0)
    return w.select("series", "start", F.size(kept).alias("kept"), r6(F.get(kept, F.size(kept) - 1)["v"]).alias("decision_pct"), r6(F.get("v", F.size("v") - 1)).alias("end_pct"), r6(hit["v"]).alias("hit_pct"), (hit["t"] - F.col("start")).alias("hit_ms"))


def bin_edges(w):
    """AF3, AF4: the 20, 40, 60 and 80 % points of all changes of each series with at least ten."""
    dl = w.select("series", F.explode(k.deltas(F.col("v"))).alias("dl"))
    dl = dl.groupBy("series").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("dl")).alias("all")).filter("n >= 10")
    return dl.select("series", "n", stats.quantiles(F.col("all"), (0.2, 0.4, 0.6, 0.8)).alias("edges"))


EDGES_SQL = POINTS_SQL + """, dls AS (SELECT series, start, i, y - lag(y) OVER (PARTITION BY series, start ORDER BY i) AS dl FROM pts),
edges AS (SELECT series, count(dl) AS n, quantile_cont(dl, [0.2, 0.4, 0.6, 0.8]) AS e FROM dls GROUP BY 1 HAVING count(dl) >= 10),
syms AS (SELECT d.series, d.start, d.i, CASE WHEN dl < e[1] THEN 'drop' WHEN dl < e[2] THEN 'dip' WHEN dl < e[3] THEN 'flat' WHEN dl < e[4] THEN 'rise' ELSE 'surge' END AS s FROM dls d JOIN edges USING (series) WHERE dl IS NOT NULL)"""


@query(f"WITH {EDGES_SQL} SELECT series, n, round(e[1], 5) AS e20, round(e[2], 5) AS e40, round(e[3], 5) AS e60, round(e[4], 5) AS e80 FROM edges")
def binning_snapshots(spark, d):
    """AF3, AF4: bin edges of changes."""
    e = bin_edges(src.curves(spark, d))
    return e.select("series", "n", *(F.round(F.get("edges", F.lit(i)), 5).alias(f"e{20 * i + 20}") for i in range(4)))


def symbol_views(spark, d):
    """AF12: windows with the symbols of their changes; series without edges are left out."""
    w = src.curves(spark, d)
    w = w.join(bin_edges(w).select("series", "edges"), "series").filter(F.size("v") >= 2)
    return w.withColumn("symbols", F.transform(k.deltas(F.col("v")), lambda x: k.symbol(x, F.col("edges"))))


@query(f"WITH {EDGES_SQL} SELECT series, s AS symbol, count(*) AS n FROM syms GROUP BY 1, 2")
def symbol_counts(spark, d):
    """AF6: five symbols by left-closed bins."""
    return symbol_views(spark, d).select("series", F.explode("symbols").alias("symbol")).groupBy("series", "symbol").agg(F.count("*").alias("n"))


PREDICATES = {
    "rise_then_dip": {"op": "has_subseq", "seq": ["rise", "dip"]},
    "busy_not_surging": {"op": "AND", "args": [{"op": "count_symbol", "symbol": "flat", "cmp": ">=", "k": 1}, {"op": "NOT", "args": [{"op": "has_subseq", "seq": ["surge"]}]}]},
    "drop_or_peaks": {"op": "OR", "args": [{"op": "has_subseq", "seq": ["drop", "drop"]}, {"op": "peak_count", "cmp": ">", "k": 3}]},
}


@query(
    f"""WITH {EDGES_SQL}, views AS (SELECT series, start, string_agg(s, ' ' ORDER BY i) AS txt, count(*) FILTER (s = 'flat') AS flats FROM syms GROUP BY 1, 2),
pk AS (SELECT series, start, count(*) FILTER ((y > py AND y > ny) OR (y < py AND y < ny)) AS peaks FROM (SELECT *, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY series, start ORDER BY i)) GROUP BY 1, 2),
hit AS (SELECT v.*, peaks, contains(' ' || txt || ' ', ' rise dip ') AS a, flats >= 1 AND NOT contains(txt, 'surge') AS b, contains(' ' || txt || ' ', ' drop drop ') OR peaks > 3 AS c FROM views v JOIN pk USING (series, start)),
u AS (SELECT series, 'rise_then_dip' AS predicate, a AS h FROM hit UNION ALL SELECT series, 'busy_not_surging', b FROM hit UNION ALL SELECT series, 'drop_or_peaks', c FROM hit)
SELECT predicate, series, count(*) AS n, count(*) FILTER (h) AS hits FROM u GROUP BY 1, 2"""
)
def predicate_hits(spark, d):
    """PF15, PF16, AF13, AF15, UD4: JSON predicates compiled to columns, then unpivoted."""
    w = symbol_views(spark, d)
    w = w.select("series", *(compile_predicate(p, F.col("symbols"), F.col("v")).alias(name) for name, p in PREDICATES.items()))
    u = w.unpivot("series", list(PREDICATES), "predicate", "hit")
    return u.groupBy("predicate", "series").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
