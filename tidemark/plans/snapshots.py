"""Queries of frozen bin edges: three dates of which one reuses, and windows read with the version of their time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import curves
from tidemark.operators.shared import new_path, written
from tidemark.operators.snapshots import FREEZE_MS, LEAST, SHARES, Snapshots, at_their_time
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import HOUR_MS, SAMPLES_SQL

DAY_MS, T0 = 24 * HOUR_MS, 1_704_067_200_000  # 2024-01-01
#: Times at which edges are ensured: a first one, one that reuses, one at which the first are 31 days old.
DATES = (T0 + 4 * DAY_MS, T0 + 20 * DAY_MS, T0 + 35 * DAY_MS)
CHANNELS = {"crowd": "CAST(participants AS DOUBLE)", "quote": "pct", "volume": "volume"}


def changes(spark, d):
    """series, channel, start and dl: changes between the samples of a window."""
    w = Window.partitionBy("series", "start").orderBy("t", "event_id")
    s = src.samples(spark, d).withColumn("start", src.bucket(F.col("t"), HOUR_MS))
    s = s.select("series", "start", *((F.expr(e) - F.lag(F.expr(e)).over(w)).alias(c) for c, e in CHANNELS.items()))
    return s.unpivot(["series", "start"], list(CHANNELS), "channel", "dl").filter("dl IS NOT NULL")


def frozen(spark, d) -> tuple[Snapshots, object]:
    """The snapshots after all dates, and the changes they were made of."""
    c = written(changes(spark, d), "changes")
    made = Snapshots(new_path(spark, "snapshots"))
    for now in DATES:
        made.ensure(c.filter(F.col("start") + HOUR_MS <= now).drop("start"), now)
    return made, c


_MADE = f"SELECT series, channel, count(dl) AS n, quantile_cont(dl, {list(SHARES)}) AS edges FROM changes WHERE start + {HOUR_MS} <= {{now}} AND series {{due}} GROUP BY 1, 2 HAVING count(dl) >= {LEAST}"
FROZEN_SQL = f"""{SAMPLES_SQL}, x AS (SELECT *, CAST(floor(t / {HOUR_MS}) * {HOUR_MS} AS BIGINT) AS start FROM samples),
y AS (SELECT series, start, t, event_id, pct, {', '.join(f'{e} - lag({e}) OVER w AS d_{c}' for c, e in CHANNELS.items())} FROM x WINDOW w AS (PARTITION BY series, start ORDER BY t, event_id)),
changes AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT series, start, '{c}' AS channel, d_{c} AS dl FROM y" for c in CHANNELS)}) WHERE dl IS NOT NULL),
v1 AS ({_MADE.format(now=DATES[0], due='IS NOT NULL')}), v2 AS ({_MADE.format(now=DATES[1], due='NOT IN (SELECT series FROM v1 GROUP BY 1 HAVING count(*) = 3)')}), held AS (SELECT series FROM v2 GROUP BY 1 HAVING count(*) = 3),
v3 AS ({_MADE.format(now=DATES[2], due='NOT IN (SELECT series FROM held)')}),
made AS ({' UNION ALL '.join(f"SELECT *, {now} AS created, 'v{now}' AS version FROM v{k}" for k, now in enumerate(DATES, 1))})"""


@query(f"WITH {FROZEN_SQL} SELECT series, channel, version, CAST(created AS BIGINT) AS created, n, round(edges[1], 6) AS e20, round(edges[2], 6) AS e40, round(edges[3], 6) AS e60, round(edges[4], 6) AS e80 FROM made")
def frozen_edges(spark, d):
    """AF5, DP33: all snapshots made on three dates: first ones, then only those of series that had none, then those of series whose
    snapshot is 30 days old; the second date reuses the first one's."""
    made, _ = frozen(spark, d)
    return made.table(spark).select("series", "channel", "version", "created", "n", *(F.round(F.get("edges", F.lit(i)), 6).alias(f"e{20 * i + 20}") for i in range(4)))


@query(
    f"""WITH {FROZEN_SQL}, valid AS (SELECT series, version, edges, created AS since, lead(created) OVER (PARTITION BY series ORDER BY created) AS until FROM made WHERE channel = 'quote'),
q AS (SELECT c.series, c.start, v.version, CASE WHEN dl < edges[1] THEN 'drop' WHEN dl < edges[2] THEN 'dip' WHEN dl < edges[3] THEN 'flat' WHEN dl < edges[4] THEN 'rise' WHEN edges IS NOT NULL THEN 'surge' END AS symbol
  FROM changes c LEFT JOIN valid v ON c.series = v.series AND c.start >= v.since AND (v.until IS NULL OR c.start < v.until) WHERE channel = 'quote')
SELECT series, version, count(*) AS changes, {', '.join(f"count(*) FILTER (symbol = '{s}') AS n_{s}" for s in curves.SYMBOLS)} FROM q GROUP BY 1, 2"""
)
def versioned_symbols(spark, d):
    """AF6, DP33: changes of quotes as symbols by the edges of the version that was valid at their time; null before the first."""
    made, c = frozen(spark, d)
    q = at_their_time(c.filter("channel = 'quote'"), made.valid(spark, "quote"), "series", F.col("start"))
    symbol = F.when(F.col("edges").isNotNull(), curves.symbol(F.col("dl"), F.col("edges")))
    return q.withColumn("symbol", symbol).groupBy("series", "version").agg(F.count("*").alias("changes"), *(F.count_if(F.col("symbol") == s).alias(f"n_{s}") for s in curves.SYMBOLS))


__all__ = ["DATES", "FREEZE_MS", "frozen_edges", "versioned_symbols"]
