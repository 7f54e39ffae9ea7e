"""Queries that draw: intervals over runs of adjacent cycles, and of what each hypothesis earns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.bootstrap import intervals_sql, ratio_intervals
from tidemark.operators.shared import written
from tidemark.plans.hypotheses import CYCLE_MS, FEATURES_SQL, HYPOTHESES, features
from tidemark.plans.registry import query
from tidemark.sources.events import HOUR_MS

#: Resamples of runs.
RUN_DRAWS = 3000
_NAMES, _CONDITIONS = list(HYPOTHESES), list(HYPOTHESES.values())


def hit_runs(rows):
    """hypothesis (its place in the catalogue), series, first, hits and ups: each run of adjacent cycles that a hypothesis hits.

    The start of the run that a cycle is in is a running maximum, so all hypotheses share one sort of a series.
    """
    w = Window.partitionBy("series").orderBy("cycle_ts")
    flags = rows.select("series", "cycle_ts", "next_d", *(F.coalesce(F.expr(c), F.lit(False)).alias(f"f{k}") for k, c in enumerate(_CONDITIONS)))
    follows = F.coalesce(F.col("cycle_ts") - F.lag("cycle_ts").over(w) == CYCLE_MS, F.lit(False))
    places = range(len(_CONDITIONS))
    marked = flags.withColumns({"follows": follows} | {f"b{k}": F.lag(f"f{k}").over(w) for k in places})
    begins = {f"s{k}": F.max(F.when(F.col(f"f{k}") & ~(F.col("follows") & F.col(f"b{k}")), F.col("cycle_ts"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in places}
    hit = F.filter(F.array(*(F.when(F.col(f"f{k}"), F.struct(F.lit(k).alias("hypothesis"), F.col(f"s{k}").alias("first"))) for k in places)), lambda x: x.isNotNull())
    each = marked.withColumns(begins).select("series", "next_d", F.inline(hit))
    return each.groupBy("hypothesis", "series", "first").agg(F.count("*").alias("hits"), F.count_if(F.col("next_d") > 0).alias("ups"))


@query(
    f"""WITH {FEATURES_SQL}, flags AS (SELECT series, cycle_ts, next_d, unnest([{', '.join(f'coalesce({c}, false)' for c in _CONDITIONS)}]) AS hit, unnest(range({len(_NAMES)})) AS hypothesis FROM feats),
marks AS (SELECT *, CASE WHEN cycle_ts - lag(cycle_ts) OVER w = {CYCLE_MS} THEN 0 ELSE 1 END AS begins FROM flags WHERE hit WINDOW w AS (PARTITION BY hypothesis, series ORDER BY cycle_ts)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY hypothesis, series ORDER BY cycle_ts ROWS UNBOUNDED PRECEDING) AS run FROM marks),
runs AS (SELECT hypothesis, series, min(cycle_ts) // {HOUR_MS} AS hour, count(*) AS hits, count(*) FILTER (next_d > 0) AS ups FROM numbered GROUP BY hypothesis, series, run),
{intervals_sql('runs', 'hypothesis', ['hypothesis', 'series', 'hour'], 'ups', 'hits', RUN_DRAWS)}, whole AS (SELECT hypothesis, count(*) AS runs, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(ups) AS BIGINT) AS ups FROM runs GROUP BY 1)
SELECT {[*_NAMES]}[hypothesis + 1] AS hypothesis, hits, ups, runs, round(ups / hits, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi FROM whole JOIN cuts USING (hypothesis)"""
)
def run_block_intervals(spark, d):
    """WF33: how often the next cycle rises after each hypothesis, with the 95 % interval of 3000 resamples of runs: adjacent
    hits depend on each other, so a run is drawn whole."""
    runs = written(hit_runs(features(spark, d)), "runs")
    whole = runs.groupBy("hypothesis").agg(F.sum("hits").alias("hits"), F.sum("ups").alias("ups"), F.count("*").alias("runs"))
    cuts = ratio_intervals(runs.withColumn("hour", F.floor(F.col("first") / HOUR_MS)), "hypothesis", ["hypothesis", "series", "hour"], "ups", "hits", RUN_DRAWS)
    name = F.get(F.array(*map(F.lit, _NAMES)), "hypothesis")
    return whole.join(cuts, "hypothesis").select(name.alias("hypothesis"), "hits", "ups", "runs", F.round(F.col("ups") / F.col("hits"), 6).alias("rate"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
