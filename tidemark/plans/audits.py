"""Queries that audit what detectors did: live profit path, repeated patterns, breaks at the boundary, cool-down."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import detection
from tidemark.plans.market import r6
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, CYCLES_SQL, HOUR_MS, SAMPLES_SQL
from tidemark.streaming.detectors import CONFIRM_MS, COOL_DOWN_MS, CYCLE_MS, DAILY_CAP, DAY_MS, TRIES

# Paths that give a pattern, the rise that adds the second half, quotes where none was seen.
PATHS = {"UUU": "bull_exhaust", "DDD": "bear_exhaust", "DUU": "momentum_fade"}
ADD_RISE, OPEN_QUOTE, ADD_QUOTE = 1.001, 0.50, 0.27
#: A cycle with less volume than this has no quotes of its own.
QUOTED_VOLUME = 300.0
#: Cosine from which two patterns of a direction are one.
SAME_COSINE = 0.95


@query(
    f"""WITH {CYCLES_SQL}, x AS (SELECT series, cycle_ts, path, lead(cycle_ts) OVER w AS nts, lead(o) OVER w AS no, lead(h) OVER w AS nh, lead(c) OVER w AS nc, lead(v) OVER w AS nv FROM cycles WINDOW w AS (PARTITION BY series ORDER BY cycle_ts)),
p(path, pattern, direction) AS (VALUES ('UUU', 'bull_exhaust', 'DOWN'), ('DDD', 'bear_exhaust', 'UP'), ('DUU', 'momentum_fade', 'DOWN')),
s AS (SELECT series, cycle_ts, pattern, direction, CASE WHEN direction = 'DOWN' THEN nc < no ELSE nc > no END AS won, nv >= 300 AS quoted, nh >= no * 1.001 AND pattern = 'bull_exhaust' AS added, no FROM x JOIN p USING (path) WHERE nts - cycle_ts = 10800000),
q AS (SELECT *, CASE WHEN quoted THEN CASE WHEN direction = 'DOWN' THEN 1 - no ELSE no END ELSE 0.5 END AS e1, CASE WHEN quoted AND 1 - no * 1.001 > 0 THEN 1 - no * 1.001 ELSE 0.27 END AS e2 FROM s),
r AS (SELECT *, CASE WHEN won THEN 0.98 / (e1 + 0.01) - 1 ELSE -1 END AS r1, CASE WHEN won THEN 0.98 / (e2 + 0.01) - 1 ELSE -1 END AS r2 FROM q)
SELECT series, cycle_ts, pattern, direction, won, quoted, added, round(CASE WHEN pattern <> 'bull_exhaust' THEN r1 WHEN added THEN 0.5 * r1 + 0.5 * r2 ELSE 0.5 * r1 END, 6) AS pnl FROM r"""
)
def live_profit_path(spark, d):
    """EV18: profit of each pattern's signal over the next cycle. Bull exhaustion takes half a position and
    adds the other half once the price has risen; the others take a whole one. Side gives the direction (G23)."""
    w = src.by_time(order="cycle_ts")
    x = src.cycles(src.bars(spark, d)).withColumns({f"n_{k}": F.lead(k).over(w) for k in ("cycle_ts", "o", "h", "c", "v")})
    x = x.filter(F.col("path").isin(*PATHS) & (F.col("n_cycle_ts") - F.col("cycle_ts") == CYCLE_MS))
    pattern = F.create_map(*(F.lit(t) for kv in PATHS.items() for t in kv))[F.col("path")]
    x = x.withColumn("pattern", pattern).withColumn("direction", F.when(F.col("pattern") == "bear_exhaust", "UP").otherwise("DOWN"))
    bull, down, risen = F.col("pattern") == "bull_exhaust", F.col("direction") == "DOWN", F.col("n_o") * ADD_RISE
    x = x.withColumns({
        "won": F.when(down, F.col("n_c") < F.col("n_o")).otherwise(F.col("n_c") > F.col("n_o")),
        "quoted": F.col("n_v") >= QUOTED_VOLUME,
        "added": bull & (F.col("n_h") >= risen),
    })
    opened = F.when(F.col("quoted"), F.when(down, 1 - F.col("n_o")).otherwise(F.col("n_o"))).otherwise(OPEN_QUOTE)
    later = F.when(F.col("quoted") & (1 - risen > 0), 1 - risen).otherwise(ADD_QUOTE)

    def gain(entry):
        return F.when(F.col("won"), 0.98 / (entry + 0.01) - 1).otherwise(-1.0)

    half = 0.5 * gain(opened)
    pnl = F.when(~bull, gain(opened)).when(F.col("added"), half + 0.5 * gain(later)).otherwise(half)
    return x.select("series", "cycle_ts", "pattern", "direction", "won", "quoted", "added", r6(pnl).alias("pnl"))


@query(
    f"""WITH {BARS_SQL}, g AS (SELECT series % 4 * 24 + CAST(bar_ts // 3600000 % 24 AS BIGINT) AS id, avg(ret) AS a, avg(o) - 0.5 AS b, avg(c) - 0.5 AS c, count(*) FILTER (outcome = 'UP') > count(*) FILTER (outcome = 'DOWN') AS up FROM bars GROUP BY 1),
p AS (SELECT id, CASE WHEN up THEN 'UP' ELSE 'DOWN' END AS direction, id % 3 <> 0 AS has_vector, a, b, c, CASE WHEN b > 0 THEN 'high' ELSE 'low' END || '|' || CASE WHEN c > b THEN 'rise' ELSE 'fall' END AS mark FROM g),
m AS (SELECT n.id, min(o.id) AS same_as FROM p n JOIN p o ON n.direction = o.direction AND o.id < n.id AND CASE WHEN n.has_vector AND o.has_vector
  THEN coalesce((n.a * o.a + n.b * o.b + n.c * o.c) / nullif(sqrt(n.a * n.a + n.b * n.b + n.c * n.c) * sqrt(o.a * o.a + o.b * o.b + o.c * o.c), 0), 0) >= 0.95 ELSE n.mark = o.mark END GROUP BY 1)
SELECT p.id, p.direction, m.same_as FROM p LEFT JOIN m USING (id)"""
)
def repeated_patterns(spark, d):
    """AF34: for each pattern the first earlier one of its direction that it repeats: by cosine where both have
    a vector, else by equal fingerprints. The catalogue has one row for each series and hour, whatever the data."""
    b = src.bars(spark, d)
    g = b.groupBy((F.col("series") % 4 * 24 + F.floor(F.col("bar_ts") / HOUR_MS) % 24).alias("id")).agg(
        F.avg("ret").alias("a"), (F.avg("o") - 0.5).alias("b"), (F.avg("c") - 0.5).alias("c"), (F.count_if(F.col("outcome") == "UP") > F.count_if(F.col("outcome") == "DOWN")).alias("up")
    )
    mark = F.concat_ws("|", F.when(F.col("b") > 0, "high").otherwise("low"), F.when(F.col("c") > F.col("b"), "rise").otherwise("fall"))
    p = g.select("id", F.when(F.col("up"), "UP").otherwise("DOWN").alias("direction"), (F.col("id") % 3 != 0).alias("has_vector"), "a", "b", "c", mark.alias("mark"))
    n, o = p.alias("n"), p.alias("o")

    def dot(x, y):
        return sum((F.col(f"{x}.{k}") * F.col(f"{y}.{k}") for k in "bc"), F.col(f"{x}.a") * F.col(f"{y}.a"))

    cosine = F.coalesce(dot("n", "o") / F.nullif(F.sqrt(dot("n", "n")) * F.sqrt(dot("o", "o")), F.lit(0.0)), F.lit(0.0))
    same = F.when(F.col("n.has_vector") & F.col("o.has_vector"), cosine >= SAME_COSINE).otherwise(F.col("n.mark") == F.col("o.mark"))
    earlier = n.join(o, (F.col("n.direction") == F.col("o.direction")) & (F.col("o.id") < F.col("n.id")) & same)
    first = earlier.groupBy(F.col("n.id").alias("id")).agg(F.min("o.id").alias("same_as"))
    return p.select("id", "direction").join(first, "id", "left")


@query(
    f"""WITH {SAMPLES_SQL}, b AS ({ORACLE_SQL["break_events"]}), seen AS (SELECT DISTINCT series, CAST(floor(t / 10800000) * 10800000 AS BIGINT) AS cycle_ts FROM samples),
n AS (SELECT *, lead(cycle_ts) OVER (PARTITION BY series ORDER BY cycle_ts) AS next_ts FROM seen)
SELECT b.series, b.cycle_ts, b.side, CASE WHEN next_ts IS NULL THEN 'PENDING' WHEN next_ts - b.cycle_ts = 10800000 THEN 'CONFIRM' ELSE 'DISCARD' END AS status FROM b JOIN n ON b.series = n.series AND b.cycle_ts = n.cycle_ts"""
)
def breaks_at_boundary(spark, d):
    """TS8, TS9: what becomes of a pending break at the next boundary seen: confirmed if no cycle was missed."""
    seen = src.samples(spark, d).select("series", src.bucket(F.col("t"), CYCLE_MS).alias("cycle_ts")).distinct()
    n = seen.withColumn("next_ts", F.lead("cycle_ts").over(src.by_time(order="cycle_ts")))
    gap = F.col("next_ts") - F.col("cycle_ts")
    status = F.when(gap.isNull(), "PENDING").when(gap == CYCLE_MS, "CONFIRM").otherwise("DISCARD")
    return detection.break_events(spark, d).join(n, ["series", "cycle_ts"]).select("series", "cycle_ts", "side", status.alias("status"))


@query(
    f"""WITH {SAMPLES_SQL}, b AS ({ORACLE_SQL["break_events"]}), x AS (SELECT series, CAST(floor(t / {CYCLE_MS}) * {CYCLE_MS} AS BIGINT) AS cycle_ts, t, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY series, floor(t / {CYCLE_MS}) ORDER BY t, event_id) AS i FROM samples),
c AS (SELECT series, cycle_ts, min(t) AS first_t, min(t) FILTER (t > cycle_ts + {CONFIRM_MS}) AS late_t, count(*) FILTER (i <= {TRIES} AND t <= cycle_ts + {CONFIRM_MS}) AS tried, min(i) FILTER (i <= {TRIES} AND t <= cycle_ts + {CONFIRM_MS} AND NOT failed) AS ok,
  list(t ORDER BY t, event_id) FILTER (i <= {TRIES}) AS ts FROM x GROUP BY 1, 2), n AS (SELECT series, cycle_ts, lead(cycle_ts) OVER w AS next_ts, lead(first_t) OVER w AS next_t, lead(late_t) OVER w AS late_t, lead(tried) OVER w AS tried, lead(ok) OVER w AS ok, lead(ts) OVER w AS ts, lead(first_t, 2) OVER w AS after_t FROM c WINDOW w AS (PARTITION BY series ORDER BY cycle_ts)),
d AS (SELECT b.series, b.cycle_ts, b.side, CASE WHEN next_ts IS NULL THEN 'PENDING' WHEN next_ts - b.cycle_ts > {CYCLE_MS} THEN 'DISCARD' WHEN ok IS NOT NULL THEN 'CONFIRM' WHEN tried = {TRIES} OR late_t IS NOT NULL OR after_t IS NOT NULL THEN 'TIMEOUT' ELSE 'PENDING' END AS status, n.* EXCLUDE (series, cycle_ts) FROM b JOIN n ON b.series = n.series AND b.cycle_ts = n.cycle_ts)
SELECT series, cycle_ts, side, status, CAST(CASE status WHEN 'CONFIRM' THEN ok WHEN 'TIMEOUT' THEN tried WHEN 'DISCARD' THEN 0 END AS INTEGER) AS tries, CASE status WHEN 'CONFIRM' THEN ts[ok] WHEN 'DISCARD' THEN next_t WHEN 'TIMEOUT' THEN CASE WHEN tried = {TRIES} THEN ts[{TRIES}] ELSE coalesce(late_t, after_t) END END AS decided_ts FROM d"""
)
def confirmed_breaks(spark, d):
    """TS8, TS9: what becomes of a pending break: discarded if a cycle was missed, else tried at the next cycle's samples, five
    at most and for two hours after the boundary, of which one with code 'error' fails. `streamed_confirmations` is the stream."""
    s = src.samples(spark, d).withColumn("cycle_ts", src.bucket(F.col("t"), CYCLE_MS))
    soon = F.col("t") <= F.col("cycle_ts") + CONFIRM_MS
    late = F.min(F.when(~soon, F.col("t"))).alias("late_t")
    tries = F.slice(F.array_sort(F.collect_list(F.when(soon, F.struct("t", "event_id", (F.col("event_type") == "error").alias("failed"))))), 1, TRIES)
    c = s.groupBy("series", "cycle_ts").agg(F.min("t").alias("first_t"), late, tries.alias("tries"))
    w = src.by_time(order="cycle_ts")
    n = c.select("series", "cycle_ts", *(F.lead(x, k).over(w).alias(name) for x, k, name in (("cycle_ts", 1, "next_ts"), ("first_t", 1, "next_t"), ("late_t", 1, "late_t"), ("tries", 1, "tries"), ("first_t", 2, "after_t"))))
    ok = F.array_position(F.transform("tries", lambda x: x["failed"]), False)
    full = F.size("tries") == TRIES
    status = F.when(F.col("next_ts").isNull(), "PENDING").when(F.col("next_ts") - F.col("cycle_ts") > CYCLE_MS, "DISCARD").when(ok > 0, "CONFIRM").when(full | F.coalesce("late_t", "after_t").isNotNull(), "TIMEOUT").otherwise("PENDING")
    x = detection.break_events(spark, d).select("series", "cycle_ts", "side").join(n, ["series", "cycle_ts"]).withColumns({"status": status, "ok": ok})
    is_ = lambda name: F.col("status") == name
    place = F.when(is_("CONFIRM"), F.col("ok")).when(is_("TIMEOUT") & full, TRIES)
    decided = F.when(place.isNotNull(), F.try_element_at("tries", place.cast("int"))["t"]).when(is_("DISCARD"), F.col("next_t")).when(is_("TIMEOUT"), F.coalesce("late_t", "after_t"))
    count = F.when(is_("CONFIRM"), F.col("ok")).when(is_("TIMEOUT"), F.size("tries")).when(is_("DISCARD"), 0)
    return x.select("series", "cycle_ts", "side", "status", count.cast("int").alias("tries"), decided.alias("decided_ts"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def cooled(times: pd.Series) -> pd.Series:
    """Of ascending times those that are COOL_DOWN_MS or more after the last one kept."""

    def kept(t: np.ndarray) -> list[int]:
        out, at = [], 0
        while at < len(t):
            out.append(int(t[at]))
            at = max(at + 1, int(np.searchsorted(t, t[at] + COOL_DOWN_MS)))
        return out

    return times.map(kept)


_KEPT_SQL = (
    f"""WITH RECURSIVE b AS ({ORACLE_SQL["break_events"]}), nx AS (SELECT s.series, s.side, s.bar_ts AS t, min(n.bar_ts) AS nt FROM b s LEFT JOIN b n ON s.series = n.series AND s.side = n.side AND n.bar_ts >= s.bar_ts + 21600000 GROUP BY 1, 2, 3),
f(series, side, t) AS (SELECT series, side, min(bar_ts) FROM b GROUP BY 1, 2 UNION SELECT f.series, f.side, nx.nt FROM f JOIN nx ON f.series = nx.series AND f.side = nx.side AND f.t = nx.t WHERE nx.nt IS NOT NULL)
"""
)
#: The signals with the cap that `streamed_cooled` counts, of a series' day.
COOLED_SQL = _KEPT_SQL + "SELECT series, side, t AS signal_ts, rank() OVER (PARTITION BY series, t // 86400000 ORDER BY t) > 8 AS over_cap FROM f"
#: Those with the cap of a day over all series, and the parts in which a day's first signals are found.
CAPPED_SQL, PARTS = _KEPT_SQL + "SELECT series, side, t AS signal_ts, row_number() OVER (PARTITION BY t // 86400000 ORDER BY t, series, side) > 8 AS over_cap FROM f", 64


def kept_signals(spark, d):
    """Signals of breaks that outlast the cool-down of their series and side. One array of times per series and side: at most two breaks a cycle."""
    b = detection.break_events(spark, d).groupBy("series", "side").agg(F.array_sort(F.collect_list("bar_ts")).alias("ts"))
    return b.select("series", "side", F.explode(cooled("ts")).alias("signal_ts"))


def cooled_signals(spark, d):
    """The batch twin of `streamed_cooled`: signals over the cap of their series' UTC day, both sides together, are kept and marked."""
    f = kept_signals(spark, d)
    day = Window.partitionBy("series", F.floor(F.col("signal_ts") / DAY_MS)).orderBy("signal_ts")
    return f.withColumn("over_cap", F.rank().over(day) > DAILY_CAP)


def capped_signals(f):
    """Signals over the cap of a UTC day over all series are kept and marked. A day's first ones are among the first ones of its parts, so no task sorts a day."""
    order = ("signal_ts", "series", "side")
    f = f.withColumns({"day": F.floor(F.col("signal_ts") / DAY_MS), "part": F.pmod(F.hash("series"), F.lit(PARTS))})
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("day", "part").orderBy(*order)))
    first = f.filter(F.col("place") <= DAILY_CAP).withColumn("over_cap", F.row_number().over(Window.partitionBy("day").orderBy(*order)) > DAILY_CAP)
    rest = f.filter(F.col("place") > DAILY_CAP).withColumn("over_cap", F.lit(True))
    return first.unionByName(rest).select("series", "side", "signal_ts", "over_cap")
