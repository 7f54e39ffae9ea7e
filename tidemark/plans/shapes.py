"""Queries of curve shapes: descriptors, line and path features, structures with arms, wedges, lock-in over a grid."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import r6
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.plans.windows import POINTS_SQL, archived_windows
from tidemark.sources import events as src
from tidemark.sources.events import CURVES_SQL, HOUR_MS, SAMPLES_SQL

#: Windows of an hour stand for windows of five minutes: a second of theirs is twelve of the clock.
SECOND = 12_000.0
# End of the head and start of the tail, depth of a structure, the reach of its fast arm, a trend's move, a flat range, grid.
HEAD_S, TAIL_S, MIN_DEPTH, FAST_S, TREND_PP, FLAT_PP, GRID = 150, 210, 12.0, 60, 12.0, 8.0, 20
KEYS = ("series", "start")


def points(spark, d):
    """The samples of each window in order: y in percent, t in seconds of a window, place i of n."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), HOUR_MS))
    w = Window.partitionBy(*KEYS).orderBy("t", "event_id")
    return s.select(*KEYS, F.col("pct").alias("y"), ((F.col("t") - F.col("start")) / SECOND).alias("sec"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(*KEYS)).alias("n"), F.col("event_type"))


_P = f"p AS (SELECT series, start, n, y, i, (t - start) / {SECOND}::DOUBLE AS sec FROM pts)"


def in_order():
    return Window.partitionBy(*KEYS).orderBy("i")



def changes(value: Column) -> Column:
    """Whether a sign that is not 0 differs from the last one that was not 0."""
    s = F.nullif(F.signum(value), F.lit(0.0))
    return F.coalesce(s != F.last(s, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))


def _changes_sql(value: str) -> str:
    s = f"nullif(sign({value}), 0)"
    return f"coalesce({s} <> last_value({s} IGNORE NULLS) OVER (PARTITION BY series, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


@query(
    f"""WITH {POINTS_SQL}, {_P}, a AS (SELECT *, y - lag(y) OVER w AS dl, max(y) OVER r - y AS fall, y - min(y) OVER r AS rise FROM p WHERE n >= 2 WINDOW w AS (PARTITION BY series, start ORDER BY i), r AS (PARTITION BY series, start ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, {_changes_sql('dl')} AS rev, {_changes_sql('y - 50')} AS crossed FROM a),
g AS (SELECT series, start, any_value(n) AS n, arg_min(y, i) AS first, arg_max(y, i) AS last, avg(y) AS mean, stddev_pop(y) AS sd, max(y) AS peak, min(i) FILTER (y = pk) AS pi, min(y) AS trough, min(i) FILTER (y = tr) AS ti, max(fall) AS max_drawdown, max(rise) AS max_runup, count(*) FILTER (rev) AS reversals, count(*) FILTER (crossed) AS cross50,
  count(*) FILTER (dl > 0) AS ups, count(*) FILTER (dl < 0) AS downs, max(y) FILTER (i = greatest(n - 3, 0)) AS tail FROM (SELECT *, max(y) OVER (PARTITION BY series, start) AS pk, min(y) OVER (PARTITION BY series, start) AS tr FROM b) GROUP BY 1, 2)
SELECT series, start, round(last - first, 6) AS net, round(mean, 6) AS mean, round(sd, 6) AS std, round(abs(mean - 50), 6) AS mean_dist_50, round(pi / (n - 1), 6) AS peak_pos, round(ti / (n - 1), 6) AS trough_pos, round(peak - first, 6) AS rise_to_peak, round(peak - last, 6) AS fall_from_peak, round(max_drawdown, 6) AS max_drawdown, round(max_runup, 6) AS max_runup,
  reversals, cross50, round(greatest(ups, downs) / (n - 1), 6) AS monotonicity, round((last - tail) / greatest(least(3, n) - 1, 1), 6) AS end_slope, round(abs(last - 50), 6) AS end_dist_50 FROM g"""
)
def shape_descriptors(spark, d):
    """AF20: what a curve's shape is, from its net move to its last slope."""
    r = in_order().rowsBetween(Window.unboundedPreceding, 0)
    p = points(spark, d).filter("n >= 2").withColumns({"dl": F.col("y") - F.lag("y").over(in_order()), "fall": F.max("y").over(r) - F.col("y"), "rise": F.col("y") - F.min("y").over(r)})
    p = p.withColumns({"rev": changes(F.col("dl")), "cross": changes(F.col("y") - 50)})
    tail = F.max(F.when(F.col("i") == F.greatest(F.col("n") - 3, F.lit(0)), F.col("y")))
    g = p.groupBy(*KEYS, "n").agg(
        F.min_by("y", "i").alias("first"), F.max_by("y", "i").alias("last"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.max("y").alias("peak"), F.min_by("i", F.struct(-F.col("y"), "i")).alias("pi"), F.min_by("i", F.struct("y", "i")).alias("ti"),
        F.max("fall").alias("max_drawdown"), F.max("rise").alias("max_runup"), F.count_if("rev").alias("reversals"), F.count_if("cross").alias("cross50"), F.count_if(F.col("dl") > 0).alias("ups"), F.count_if(F.col("dl") < 0).alias("downs"), tail.alias("tail"),
    )
    last, steps = F.col("last"), F.col("n") - 1
    return g.select(
        *KEYS, r6(last - F.col("first")).alias("net"), r6("mean").alias("mean"), r6("sd").alias("std"), r6(F.abs(F.col("mean") - 50)).alias("mean_dist_50"), r6(F.col("pi") / steps).alias("peak_pos"), r6(F.col("ti") / steps).alias("trough_pos"), r6(F.col("peak") - F.col("first")).alias("rise_to_peak"),
        r6(F.col("peak") - last).alias("fall_from_peak"), r6("max_drawdown").alias("max_drawdown"), r6("max_runup").alias("max_runup"), "reversals", "cross50", r6(F.greatest("ups", "downs") / steps).alias("monotonicity"), r6((last - F.col("tail")) / F.greatest(F.least(F.lit(3), F.col("n")) - 1, F.lit(1))).alias("end_slope"), r6(F.abs(last - 50)).alias("end_dist_50"),
    )


@query(
    f"""WITH {POINTS_SQL}, {_P}, a AS (SELECT *, y - lag(y) OVER (PARTITION BY series, start ORDER BY i) AS dl, max(y) OVER q AS pk, min(y) OVER q AS tr FROM p WHERE n >= 4 WINDOW q AS (PARTITION BY series, start)), b AS (SELECT *, {_changes_sql('CASE WHEN abs(dl) > 0.5 THEN dl ELSE 0 END')} AS flip FROM a),
g AS (SELECT series, start, any_value(n) AS n, arg_min(y, i) AS first, arg_max(y, i) AS last, max(y) AS hi, min(y) AS lo, regr_slope(y, sec) AS slope, count(*) FILTER (flip) AS chop, bool_and(dl >= -1) AS mono_up, bool_and(dl <= 1) AS mono_dn, min(i) FILTER (y = pk) / (any_value(n) - 1) AS peak_pos, min(i) FILTER (y = tr) / (any_value(n) - 1) AS trough_pos FROM b GROUP BY 1, 2)
SELECT series, start, round(slope * 300, 4) AS slope, chop, mono_up, mono_dn, trough_pos < 0.5 AND last - first > 3 AND lo < first - 3 AS v_shape, peak_pos < 0.5 AND last - first < -3 AND hi > first + 3 AS inv_v, last >= hi - 2 AS close_hi, last <= lo + 2 AS close_lo FROM g"""
)
def line_features(spark, d):
    """AF21: least squares slope over time, chop, monotone, V and inverse V, close at the extremes; of four points or more."""
    p = points(spark, d).filter("n >= 4").withColumn("dl", F.col("y") - F.lag("y").over(in_order()))
    p = p.withColumn("flip", changes(F.when(F.abs("dl") > 0.5, F.col("dl")).otherwise(0.0)))
    steps = F.col("n") - 1
    g = p.groupBy(*KEYS, "n").agg(
        F.min_by("y", "i").alias("first"), F.max_by("y", "i").alias("last"), F.max("y").alias("hi"), F.min("y").alias("lo"), F.regr_slope("y", "sec").alias("slope"), F.count_if("flip").alias("chop"),
        F.min(F.col("dl") >= -1).alias("mono_up"), F.min(F.col("dl") <= 1).alias("mono_dn"), F.min_by("i", F.struct(-F.col("y"), "i")).alias("pi"), F.min_by("i", F.struct("y", "i")).alias("ti"),
    )
    move = F.col("last") - F.col("first")
    v = (F.col("ti") / steps < 0.5) & (move > 3) & (F.col("lo") < F.col("first") - 3)
    iv = (F.col("pi") / steps < 0.5) & (move < -3) & (F.col("hi") > F.col("first") + 3)
    return g.select(*KEYS, F.round(F.col("slope") * 300, 4).alias("slope"), "chop", "mono_up", "mono_dn", v.alias("v_shape"), iv.alias("inv_v"), (F.col("last") >= F.col("hi") - 2).alias("close_hi"), (F.col("last") <= F.col("lo") + 2).alias("close_lo"))


@query(
    f"""WITH {POINTS_SQL}, {_P}, a AS (SELECT *, y - lag(y) OVER (PARTITION BY series, start ORDER BY i) AS dl, first_value(y) OVER (PARTITION BY series, start ORDER BY i) AS y0 FROM p WHERE n >= 4),
g AS (SELECT series, start, any_value(y0) AS y0, arg_max(y, i) AS last, sum(abs(dl)) AS way, arg_max(y, i) FILTER (sec <= {HEAD_S}) AS head, arg_max(y, i) FILTER (sec <= {TAIL_S}) AS tail, avg(CASE WHEN y >= 60 THEN 1.0 ELSE 0.0 END) AS hi_share, avg(CASE WHEN y <= 40 THEN 1.0 ELSE 0.0 END) AS lo_share, min(sec) FILTER (i > 0 AND (y0 >= 50) <> (y >= 50)) AS t_cross FROM a GROUP BY 1, 2)
SELECT series, start, CASE WHEN way >= 3 THEN round(abs(last - y0) / way, 6) END AS efficiency, round(head - y0, 6) AS d_head, round(last - tail, 6) AS d_tail, round(hi_share, 6) AS hi_share, round(lo_share, 6) AS lo_share, round(t_cross, 6) AS t_cross, CASE WHEN y0 >= 50 THEN 'dn' ELSE 'up' END AS cross_dir FROM g"""
)
def path_features(spark, d):
    """AF22: path efficiency, moves of head and tail, shares of time high and low, first crossing of 50."""
    p = points(spark, d).filter("n >= 4").withColumns({"dl": F.col("y") - F.lag("y").over(in_order()), "y0": F.first("y").over(in_order())})
    upto = lambda s: F.max_by(F.when(F.col("sec") <= s, F.col("y")), F.when(F.col("sec") <= s, F.col("i")))
    crossed = (F.col("i") > 0) & ((F.col("y0") >= 50) != (F.col("y") >= 50))
    g = p.groupBy(*KEYS, "y0").agg(F.max_by("y", "i").alias("last"), F.sum(F.abs("dl")).alias("way"), upto(HEAD_S).alias("head"), upto(TAIL_S).alias("tail"), F.avg((F.col("y") >= 60).cast("double")).alias("hi_share"), F.avg((F.col("y") <= 40).cast("double")).alias("lo_share"), F.min(F.when(crossed, F.col("sec"))).alias("t_cross"))
    y0, last = F.col("y0"), F.col("last")
    return g.select(*KEYS, F.when(F.col("way") >= 3, r6(F.abs(last - y0) / F.col("way"))).alias("efficiency"), r6(F.col("head") - y0).alias("d_head"), r6(last - F.col("tail")).alias("d_tail"), r6("hi_share").alias("hi_share"), r6("lo_share").alias("lo_share"), F.round("t_cross", 6).alias("t_cross"), F.when(y0 >= 50, "dn").otherwise("up").alias("cross_dir"))


@query(
    f"""WITH {POINTS_SQL}, {_P}, a AS (SELECT *, min(y) OVER q AS lo, max(y) OVER q AS hi FROM p WHERE n >= 6 WINDOW q AS (PARTITION BY series, start)), b AS (SELECT *, min(i) FILTER (y = lo) OVER q AS im, min(i) FILTER (y = hi) OVER q AS ix FROM a WINDOW q AS (PARTITION BY series, start)),
c AS (SELECT series, start, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n, any_value(im) AS im, any_value(ix) AS ix, arg_min(y, i) AS y0, arg_max(y, i) AS y1, least(max(y) FILTER (i <= im), max(y) FILTER (i >= im)) - any_value(lo) AS dv, any_value(hi) - greatest(min(y) FILTER (i <= ix), min(y) FILTER (i >= ix)) AS div,
  arg_min(i, (-y, i)) FILTER (i <= im) AS vl, arg_min(i, (-y, i)) FILTER (i >= im) AS vr, arg_min(i, (y, i)) FILTER (i <= ix) AS xl, arg_min(i, (y, i)) FILTER (i >= ix) AS xr FROM b GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN dv >= {MIN_DEPTH} AND dv >= div THEN 'V' WHEN div >= {MIN_DEPTH} AND div > dv THEN 'INV_V' WHEN abs(y1 - y0) >= {TREND_PP} THEN CASE WHEN y1 > y0 THEN 'TREND_UP' ELSE 'TREND_DN' END WHEN hi - lo <= {FLAT_PP} THEN 'FLAT' ELSE 'OTHER' END AS kind FROM c),
m AS (SELECT *, CASE WHEN kind = 'V' THEN im WHEN kind = 'INV_V' THEN ix END AS ext, CASE WHEN kind = 'V' THEN vl WHEN kind = 'INV_V' THEN xl END AS l, CASE WHEN kind = 'V' THEN vr WHEN kind = 'INV_V' THEN xr END AS r FROM k),
s AS (SELECT m.series, m.start, regr_slope(p.y, p.sec) FILTER (p.i BETWEEN l AND ext) * 60 AS s_left, regr_slope(p.y, p.sec) FILTER (p.i BETWEEN ext AND r) * 60 AS s_right, regr_slope(p.y, p.sec) * 60 AS s_all, regr_slope(p.y, p.sec) FILTER (p.sec BETWEEN e.sec AND e.sec + {FAST_S}) * 60 AS s_fast, count(*) FILTER (p.sec BETWEEN e.sec AND e.sec + {FAST_S}) AS n_fast, count(*) FILTER (p.i BETWEEN l AND ext) AS n_left, count(*) FILTER (p.i BETWEEN ext AND r) AS n_right
  FROM m JOIN p ON p.series = m.series AND p.start = m.start LEFT JOIN p e ON e.series = m.series AND e.start = m.start AND e.i = m.ext GROUP BY 1, 2)
SELECT m.series, m.start, kind, round(CASE kind WHEN 'V' THEN dv WHEN 'INV_V' THEN div ELSE 0 END, 6) AS depth, round(ext / (n - 1), 6) AS ext_pos, CASE WHEN n_left >= 2 THEN round(s_left, 4) END AS s_left, round(CASE WHEN kind LIKE 'TREND%' THEN s_all WHEN n_right >= 2 THEN s_right END, 4) AS s_right,
  round(CASE WHEN ext IS NULL THEN NULL WHEN n_fast >= 3 THEN s_fast WHEN n_right >= 2 THEN s_right END, 4) AS s_fast FROM m JOIN s ON m.series = s.series AND m.start = s.start"""
)
def curve_structures(spark, d):
    """AF23: V, inverse V, trend or flat, with depth, place of the extremum and slopes of its arms and of its first minute.
    Where both shapes are deep the deeper one names the curve, so a double never remains."""
    whole = Window.partitionBy(*KEYS)
    i, y = F.col("i"), F.col("y")
    b = points(spark, d).filter("n >= 6").withColumns({"lo": F.min("y").over(whole), "hi": F.max("y").over(whole)})
    b = b.withColumns({"im": F.min(F.when(y == F.col("lo"), i)).over(whole), "ix": F.min(F.when(y == F.col("hi"), i)).over(whole), "y0": F.first("y").over(in_order())})
    up_to, on = lambda e: i <= F.col(e), lambda e: i >= F.col(e)
    over = lambda f, c: f(F.when(c, y)).over(whole)
    b = b.withColumns({"dv": F.least(over(F.max, up_to("im")), over(F.max, on("im"))) - F.col("lo"), "div": F.col("hi") - F.greatest(over(F.min, up_to("ix")), over(F.min, on("ix"))), "y1": F.last("y").over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    move = F.col("y1") - F.col("y0")
    kind = F.when((F.col("dv") >= MIN_DEPTH) & (F.col("dv") >= F.col("div")), "V").when((F.col("div") >= MIN_DEPTH) & (F.col("div") > F.col("dv")), "INV_V").when(F.abs(move) >= TREND_PP, F.when(move > 0, "TREND_UP").otherwise("TREND_DN")).when(F.col("hi") - F.col("lo") <= FLAT_PP, "FLAT").otherwise("OTHER")
    b = b.withColumn("kind", kind).withColumns({"ext": F.when(F.col("kind") == "V", F.col("im")).when(F.col("kind") == "INV_V", F.col("ix")), "sign": F.when(F.col("kind") == "V", -1.0).otherwise(1.0)})
    shoulder = lambda side: F.min_by(F.when(side, i), F.when(side, F.struct(F.col("sign") * y, i))).over(whole)
    b = b.withColumns({"l": shoulder(up_to("ext")), "r": shoulder(on("ext")), "at": F.max(F.when(i == F.col("ext"), F.col("sec"))).over(whole)})
    left, right, fast = i.between(F.col("l"), F.col("ext")), i.between(F.col("ext"), F.col("r")), F.col("sec").between(F.col("at"), F.col("at") + FAST_S)
    slope = lambda c: F.regr_slope(F.when(c, y), F.when(c, F.col("sec"))) * 60
    g = b.groupBy(*KEYS, "kind", "ext", "n", "dv", "div").agg(slope(left).alias("sl"), slope(right).alias("sr"), slope(fast).alias("sf"), (F.regr_slope("y", "sec") * 60).alias("sa"), F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.count_if(fast).alias("nf"))
    arm = F.when(F.col("nr") >= 2, F.col("sr"))
    return g.select(
        *KEYS, "kind", r6(F.when(F.col("kind") == "V", F.col("dv")).when(F.col("kind") == "INV_V", F.col("div")).otherwise(0.0)).alias("depth"), r6(F.col("ext") / (F.col("n") - 1)).alias("ext_pos"), F.when(F.col("nl") >= 2, F.round("sl", 4)).alias("s_left"),
        F.round(F.when(F.col("kind").startswith("TREND"), F.col("sa")).otherwise(arm), 4).alias("s_right"), F.round(F.when(F.col("ext").isNull(), None).when(F.col("nf") >= 3, F.col("sf")).otherwise(arm), 4).alias("s_fast"),
    )


@query(
    f"""WITH {SAMPLES_SQL}, g AS (SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, arg_min(pct, (t, event_id)) FILTER (event_type = 'purchase') AS p0, arg_max(pct, (t, event_id)) FILTER (event_type = 'purchase') AS p1, arg_min(pct, (t, event_id)) FILTER (event_type <> 'purchase') AS c0, arg_max(pct, (t, event_id)) FILTER (event_type <> 'purchase') AS c1 FROM samples GROUP BY 1, 2)
SELECT series, start, round(p1 - c1, 6) AS wedge_end, round((p1 - c1) - (p0 - c0), 6) AS wedge_change FROM g WHERE p0 IS NOT NULL AND c0 IS NOT NULL"""
)
def wedges(spark, d):
    """AF24: how far a token's price stands from the chance at the end of a window, and how that has changed."""
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), HOUR_MS))
    at, token = F.struct("t", "event_id"), F.col("event_type") == "purchase"
    ends = lambda c: (F.min_by(F.when(c, F.col("pct")), F.when(c, at)), F.max_by(F.when(c, F.col("pct")), F.when(c, at)))
    (p0, p1), (c0, c1) = ends(token), ends(~token)
    g = s.groupBy(*KEYS).agg(p0.alias("p0"), p1.alias("p1"), c0.alias("c0"), c1.alias("c1")).dropna(subset=["p0", "c0"])
    end = F.col("p1") - F.col("c1")
    return g.select(*KEYS, r6(end).alias("wedge_end"), r6(end - (F.col("p0") - F.col("c0"))).alias("wedge_change"))


_GRID_SQL = f"""{CURVES_SQL}, gr AS (SELECT series, start, CASE WHEN v[-1] > v[1] THEN 'UP' WHEN v[-1] < v[1] THEN 'DOWN' ELSE 'NOISE' END AS outcome, list_transform(range({GRID}), lambda p: v[CAST(floor(p * (len(v) - 1) / {GRID - 1}.0::DOUBLE) AS BIGINT) + 1] + (v[least(CAST(floor(p * (len(v) - 1) / {GRID - 1}.0::DOUBLE) AS BIGINT) + 2, len(v))] - v[CAST(floor(p * (len(v) - 1) / {GRID - 1}.0::DOUBLE) AS BIGINT) + 1]) * (p * (len(v) - 1) / {GRID - 1}.0::DOUBLE - floor(p * (len(v) - 1) / {GRID - 1}.0::DOUBLE))) AS g FROM curves WHERE len(v) >= 2)"""


def on_grid(spark, d):
    """TB11: each window's curve at GRID even places, between its points by straight lines."""
    c = src.curves(spark, d).filter(F.size("v") >= 2)
    steps = F.size("v") - 1

    def place(p: Column) -> Column:
        x = p * steps / float(GRID - 1)
        i = F.floor(x).cast("int")
        a = F.get("v", i)
        return a + (F.get("v", F.least(i + 1, steps)) - a) * (x - F.floor(x))

    move = F.get("v", steps) - F.get("v", F.lit(0))
    return c.select(*KEYS, src.outcome(move).alias("outcome"), F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), place).alias("g"))


@query(
    f"""WITH {_GRID_SQL}, x AS (SELECT outcome, unnest(g) AS y, unnest(range({GRID})) AS pos FROM gr), s AS (SELECT pos, CAST(count(*) FILTER (outcome = 'UP') AS DOUBLE) AS nu, CAST(count(*) FILTER (outcome = 'DOWN') AS DOUBLE) AS nd, avg(y) FILTER (outcome = 'UP') AS mu, avg(y) FILTER (outcome = 'DOWN') AS md, var_samp(y) FILTER (outcome = 'UP') AS vu, var_samp(y) FILTER (outcome = 'DOWN') AS vd,
  count(*) FILTER (outcome <> 'NOISE' AND (y >= 50) = (outcome = 'UP')) AS right_side, count(*) FILTER (outcome <> 'NOISE' AND round(y, 9) >= 70) AS n70, count(*) FILTER (outcome = 'UP' AND round(y, 9) >= 70) AS k70, count(*) FILTER (outcome <> 'NOISE' AND round(y, 9) <= 30) AS n30, count(*) FILTER (outcome = 'DOWN' AND round(y, 9) <= 30) AS k30 FROM x GROUP BY 1)
SELECT CAST(pos AS INTEGER) AS pos, CAST(nu + nd AS BIGINT) AS decisive, round(right_side / (nu + nd), 6) AS accuracy, round(CASE WHEN nu > 1 AND nd > 1 THEN (mu - md) / sqrt(((nu - 1) * vu + (nd - 1) * vd) / (nu + nd - 2)) END, 4) AS cohens_d, round(mu, 5) AS mean_up, round(md, 5) AS mean_down, n70, round(k70 / nullif(n70, 0), 6) AS p_up, n30, round(k30 / nullif(n30, 0), 6) AS p_down, round(n70 / (nu + nd), 6) AS coverage FROM s"""
)
def lock_in(spark, d):
    """TB11, AG22: at each place of the grid how often the side of 50 is the outcome's, effect size, means, threshold gates."""
    x = on_grid(spark, d).select("outcome", F.posexplode("g").alias("pos", "y"))
    up, down, y = F.col("outcome") == "UP", F.col("outcome") == "DOWN", F.col("y")
    z = F.round(y, 9)
    g = x.groupBy("pos").agg(
        F.count_if(up).alias("nu"), F.count_if(down).alias("nd"), F.avg(F.when(up, y)).alias("mu"), F.avg(F.when(down, y)).alias("md"), F.var_samp(F.when(up, y)).alias("vu"), F.var_samp(F.when(down, y)).alias("vd"), F.count_if((up | down) & ((y >= 50) == up)).alias("right"),
        F.count_if((up | down) & (z >= 70)).alias("n70"), F.count_if(up & (z >= 70)).alias("k70"), F.count_if((up | down) & (z <= 30)).alias("n30"), F.count_if(down & (z <= 30)).alias("k30"),
    )
    nu, nd = F.col("nu"), F.col("nd")
    pooled = F.sqrt(((nu - 1) * F.col("vu") + (nd - 1) * F.col("vd")) / (nu + nd - 2))
    share = lambda k, n: r6(F.col(k) / F.nullif(F.col(n), F.lit(0)))
    return g.select("pos", (nu + nd).alias("decisive"), r6(F.col("right") / (nu + nd)).alias("accuracy"), F.round(F.when((nu > 1) & (nd > 1), (F.col("mu") - F.col("md")) / pooled), 4).alias("cohens_d"), F.round("mu", 5).alias("mean_up"), F.round("md", 5).alias("mean_down"), "n70", share("k70", "n70").alias("p_up"), "n30", share("k30", "n30").alias("p_down"), r6(F.col("n70") / (nu + nd)).alias("coverage"))


_PCTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@query(
    f"""WITH {_GRID_SQL}, k AS (SELECT CASE WHEN sign(g[-1] - 50) = 0 THEN {GRID - 1} ELSE coalesce(list_max(list_filter(range({GRID}), lambda p: sign(g[p + 1] - 50) <> sign(g[-1] - 50))) + 1, 0) END AS idx FROM gr WHERE outcome <> 'NOISE'), q AS (SELECT quantile_cont(idx::DOUBLE, {list(_PCTS)}) AS q FROM k)
SELECT unnest({list(_PCTS)}::DOUBLE[]) AS share, round(unnest(q), 6) AS lock_index, round(unnest(q) / {GRID - 1} * 300, 4) AS lock_seconds FROM q"""
)
def lock_times(spark, d):
    """AG22, ST23: percentiles of the place from which a curve stays on its final side of 50; places are counted first."""
    side = lambda y: F.signum(y - 50)
    end = F.get("g", F.lit(GRID - 1))
    others = F.filter(F.transform("g", lambda y, i: F.when(side(y) != side(end), i)), lambda i: i.isNotNull())
    idx = F.when(side(end) == 0, GRID - 1).otherwise(F.coalesce(F.array_max(others) + 1, F.lit(0)))
    k = on_grid(spark, d).filter("outcome <> 'NOISE'").groupBy(idx.alias("idx")).agg(F.count("*").alias("n"))
    q = k.agg(F.percentile(F.col("idx").cast("double"), list(_PCTS), F.col("n")).alias("q")).select(F.posexplode("q").alias("j", "x"))
    return q.select(F.get(F.array(*map(F.lit, _PCTS)), F.col("j")).alias("share"), r6("x").alias("lock_index"), F.round(F.col("x") / (GRID - 1) * 300, 4).alias("lock_seconds"))


# Pre-declared hypotheses on a window's curve and wedge: condition, and the outcome that the next window should have.
SENTIMENT = {
    "monotone_up": ("mono_up", "UP"), "monotone_down": ("mono_dn", "DOWN"), "v_shape": ("v_shape", "UP"), "inverse_v": ("inv_v", "DOWN"), "closed_high": ("close_hi", "UP"), "closed_low": ("close_lo", "DOWN"), "steep_up": ("slope > 20", "UP"), "steep_down": ("slope < -20", "DOWN"),
    "choppy": ("chop >= 2", "DOWN"), "straight_up": ("efficiency >= 0.6 AND d_tail > 0", "UP"), "straight_down": ("efficiency >= 0.6 AND d_tail < 0", "DOWN"), "late_rise": ("d_tail > 10", "UP"), "late_fall": ("d_tail < -10", "DOWN"), "early_rise": ("d_head > 10", "UP"), "early_fall": ("d_head < -10", "DOWN"),
    "stayed_high": ("hi_share >= 0.8", "UP"), "stayed_low": ("lo_share >= 0.8", "DOWN"), "crossed_up_early": ("t_cross < 100 AND cross_dir = 'up'", "UP"), "crossed_down_late": ("t_cross > 200 AND cross_dir = 'dn'", "DOWN"),
    "dear_token": ("wedge_end > 10", "DOWN"), "cheap_token": ("wedge_end < -10", "UP"), "wedge_opens": ("wedge_change > 10", "DOWN"), "wedge_closes": ("wedge_change < -10", "UP"),
}


@query(
    f"WITH a AS ({ORACLE_SQL['archived_windows']}), l AS ({ORACLE_SQL['line_features']}), q AS ({ORACLE_SQL['path_features']}), w AS ({ORACLE_SQL['wedges']}), n AS (SELECT series, start, lead(start) OVER o AS next_start, lead(outcome) OVER o AS next_outcome FROM a WINDOW o AS (PARTITION BY series ORDER BY start)), "
    + "x AS (SELECT * FROM n JOIN l USING (series, start) JOIN q USING (series, start) LEFT JOIN w USING (series, start) WHERE next_start - start = 3600000 AND next_outcome <> 'NOISE'), c AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS hypothesis, '{side}' AS expected, count(*) FILTER ({e}) AS n, count(*) FILTER (({e}) AND next_outcome = '{side}') AS k FROM x" for k, (e, side) in SENTIMENT.items())
    + f") SELECT hypothesis, expected, n, k, CASE WHEN n > 0 THEN round(least(1.0, 2 * {stats.normal_cdf_sql('(-greatest((abs(k - n * 0.5) - 0.5) / sqrt(n * 0.25), 0))')}), 7) END AS p FROM c"
)
def sentiment_hypotheses(spark, d):
    """AF21, AF22, AF24: hypotheses on a window's line, path and wedge against the outcome of the window right after it, counted in one pass."""
    w = Window.partitionBy("series").orderBy("start")
    n = archived_windows(spark, d).select(*KEYS, F.lead("start").over(w).alias("next_start"), F.lead("outcome").over(w).alias("next_outcome"))
    n = n.filter((F.col("next_start") - F.col("start") == HOUR_MS) & (F.col("next_outcome") != "NOISE"))
    x = n.join(line_features(spark, d), list(KEYS)).join(path_features(spark, d), list(KEYS)).join(wedges(spark, d), list(KEYS), "left")
    aggs, cells = [], []
    for i, (name, (e, side)) in enumerate(SENTIMENT.items()):
        aggs += [F.count_if(F.expr(e)).alias(f"n{i}"), F.count_if(F.expr(e) & (F.col("next_outcome") == side)).alias(f"k{i}")]
        cells.append(F.struct(F.lit(name).alias("hypothesis"), F.lit(side).alias("expected"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k")))
    c = x.agg(*aggs).select(F.inline(F.array(*cells)))
    return c.withColumn("p", F.when(F.col("n") > 0, F.round(stats.normal_p(F.col("k"), F.nullif(F.col("n"), F.lit(0)), F.lit(0.5)), 7)))


CLUSTER_ON = ["net", "mean", "std", "peak_pos", "trough_pos", "reversals", "monotonicity", "end_slope"]


def clusters(rows, k: int = 6, seed: int = 17):
    """The rows with their cluster: k-means on standardised features, both fitted on the rows of the first half."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=CLUSTER_ON, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster")]
    return Pipeline(stages=steps).fit(rows.filter(F.col("start") < HALF)).transform(rows)


@query()
def cluster_track(spark, d):
    """DP16, AG20: clusters of shapes from the first half vote with their majority on the windows of the second: a scorecard for each."""
    rows = shape_descriptors(spark, d).join(archived_windows(spark, d).select(*KEYS, "outcome").filter("outcome <> 'NOISE'"), list(KEYS))
    x = clusters(rows)
    early, up = F.col("start") < HALF, F.col("outcome") == "UP"
    g = x.groupBy("cluster").agg(F.count_if(early).alias("n_train"), F.count_if(early & up).alias("up_train"), F.count_if(~early).alias("n_holdout"), F.count_if(~early & up).alias("up_holdout"))
    vote = F.when(2 * F.col("up_train") >= F.col("n_train"), "UP").otherwise("DOWN")
    right = F.when(vote == "UP", F.col("up_holdout")).otherwise(F.col("n_holdout") - F.col("up_holdout"))
    return g.select("cluster", "n_train", vote.alias("vote"), "n_holdout", right.alias("right"), r6(stats.wilson_lower(right, F.col("n_holdout"))).alias("wilson_lo"))
