"""Views of the market's concepts over the events table: samples, bars, cycles and curve windows.

The same views as SQL text, so that every query and its SQL read identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats

HOUR_MS = 3_600_000
BARS_OF_CYCLE = 3
#: Users whose events make up one series: the number of series grows with the users, and a series does not.
USERS_OF_SERIES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote sample per event: series, time in ms, quote in (0, 1), percent, volume, participants."""
    e = table(spark, sf_dir, "events")
    q = F.least(F.greatest(F.col("value") / 100, F.lit(0.01)), F.lit(0.99))
    return e.select(
        "event_id",
        F.floor(F.col("user_id") / USERS_OF_SERIES).alias("series"),
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        q.alias("q"),
        (q * 100).alias("pct"),
        F.col("value").alias("volume"),
        (F.col("user_id") % 1000).alias("participants"),
    )


SAMPLES_SQL = """samples AS (
  SELECT event_id, user_id // 40 AS series, event_type, epoch_us(ts) // 1000 AS t,
    least(greatest(value / 100, 0.01), 0.99) AS q, 100 * least(greatest(value / 100, 0.01), 0.99) AS pct,
    value AS volume, user_id % 1000 AS participants FROM events)"""


def bucket(t, width: int):
    """Start of the bucket of width ms that holds t."""
    return (F.floor(t / width) * width).cast("long")


def bars(spark: SparkSession, sf_dir: str, width: int = HOUR_MS) -> DataFrame:
    """Open, high, low, close, volume (summed in the order of events) and count of each series and bucket, with return and outcome."""
    s = samples(spark, sf_dir).withColumn("bar_ts", bucket(F.col("t"), width))
    first = F.struct("t", "event_id")
    b = s.groupBy("series", "bar_ts").agg(
        F.min_by("q", first).alias("o"), F.max("q").alias("h"), F.min("q").alias("l"), F.max_by("q", first).alias("c"), stats.sum_in_order("volume", "event_id").alias("v"), F.count("*").alias("n")
    )
    ret = F.col("c") / F.col("o") - 1
    return b.withColumn("ret", ret).withColumn("outcome", outcome(F.col("ret")))


def outcome(ret):
    """UP, DOWN, NOISE at exactly 0, null where it is missing."""
    return F.when(ret > 0, "UP").when(ret < 0, "DOWN").when(ret == 0, "NOISE")


BARS_SQL = (
    SAMPLES_SQL
    + """, bars AS (
  SELECT *, c / o - 1 AS ret, CASE WHEN c / o - 1 > 0 THEN 'UP' WHEN c / o - 1 < 0 THEN 'DOWN' ELSE 'NOISE' END AS outcome FROM (
    SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS bar_ts, arg_min(q, (t, event_id)) AS o, max(q) AS h, min(q) AS l,
      arg_max(q, (t, event_id)) AS c, sum(volume) AS v, count(*) AS n FROM samples GROUP BY ALL))"""
)


def cycles(b: DataFrame, width: int = HOUR_MS, parts: int = BARS_OF_CYCLE) -> DataFrame:
    """Cycles of `parts` bars of which none is missing, with the path of bar directions."""
    d = F.when(F.col("c") > F.col("o"), "U").when(F.col("c") < F.col("o"), "D").otherwise("F")
    b = b.withColumn("cycle_ts", bucket(F.col("bar_ts"), width * parts)).withColumn("d", d)
    got = b.groupBy("series", "cycle_ts").agg(
        F.count("*").alias("n_bars"),
        F.min_by("o", "bar_ts").alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", "bar_ts").alias("c"),
        stats.sum_in_order("v", "bar_ts").alias("v"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar_ts", "d"))), lambda x: x["d"]), "").alias("path"),
    )
    return got.filter(F.col("n_bars") == parts).drop("n_bars")


CYCLES_SQL = (
    BARS_SQL
    + """, cycles AS (
  SELECT series, CAST(floor(bar_ts / 10800000) * 10800000 AS BIGINT) AS cycle_ts, arg_min(o, bar_ts) AS o, max(h) AS h, min(l) AS l,
    arg_max(c, bar_ts) AS c, sum(v) AS v, string_agg(CASE WHEN c > o THEN 'U' WHEN c < o THEN 'D' ELSE 'F' END, '' ORDER BY bar_ts) AS path
  FROM bars GROUP BY 1, 2 HAVING count(*) = 3)"""
)


def curves(spark: SparkSession, sf_dir: str, width: int = HOUR_MS) -> DataFrame:
    """Curve windows: the samples of a bucket as an array of (t, v) in time order."""
    s = samples(spark, sf_dir).withColumn("start", bucket(F.col("t"), width))
    point = F.struct("t", "event_id", F.col("pct").alias("v"))
    got = s.groupBy("series", "start").agg(
        F.array_sort(F.collect_list(point)).alias("curve"), F.count("*").alias("sample_count"), F.avg("participants").alias("mean_participants"), F.avg("volume").alias("mean_volume")
    )
    return got.withColumn("v", F.transform("curve", lambda p: p["v"]))


CURVES_SQL = (
    SAMPLES_SQL
    + """, curves AS (
  SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, list(pct ORDER BY t, event_id) AS v, list(t ORDER BY t, event_id) AS ts,
    count(*) AS sample_count, avg(participants) AS mean_participants, avg(volume) AS mean_volume FROM samples GROUP BY 1, 2)"""
)


def by_time(*keys: str, order: str = "bar_ts"):
    return Window.partitionBy(*(keys or ("series",))).orderBy(order)
