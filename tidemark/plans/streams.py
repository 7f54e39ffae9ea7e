"""A stream run to its end, so that its windows can be read as a table."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from tidemark.functions import ev
from tidemark.operators.shared import new_path
from tidemark.plans import audits
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, SAMPLES_SQL
from tidemark.streaming import detectors, windows


def run_to_end(spark, d, change, schema: str):
    """The rows that a file stream of the events gives through change, once it has read all."""
    run = new_path(spark, "stream")
    q = change(event_stream(spark, d)).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{run}/out")


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT max(t) AS now FROM samples) SELECT series, bar_ts, n, round(c, 6) AS c FROM bars, m WHERE bar_ts + 3600000 <= now - 15000"""
)
def streamed_windows(spark, d):
    """TS4: the hourly windows that the watermark has closed, from a file stream: all but those that end within its grace."""
    out = run_to_end(spark, d, windows.archive, "series long, bar_ts long, n long, o double, h double, l double, c double")
    return out.select("series", "bar_ts", "n", F.round("c", 6).alias("c"))


@query(f"WITH {SAMPLES_SQL} SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, CAST((t % 3600000) // 180000 AS INTEGER) AS tick, count(*) AS n, round(arg_max(q, (t, event_id)), 6) AS q FROM samples GROUP BY 1, 2, 3 HAVING max(t // 180000 * 180000 + 180000) <= (SELECT max(t) FROM samples) - 15000")
def streamed_ticks(spark, d):
    """TS1: the last quote of each aligned tick (three minutes of an hour stand for 15 seconds of five minutes); a restarted run goes on from its checkpoint."""
    out = run_to_end(spark, d, windows.ticks, "series long, tick_ts long, n long, q double")
    start = F.floor(F.col("tick_ts") / 3_600_000) * 3_600_000
    return out.select("series", start.alias("start"), ((F.col("tick_ts") - start) / 180_000).cast("int").alias("tick"), "n", F.round("q", 6).alias("q"))


@query(f"WITH {SAMPLES_SQL} SELECT series, CAST(floor(t / 10800000) * 10800000 AS BIGINT) AS cycle_ts, round(arg_min(q, (t, event_id)), 6) AS open_q FROM samples GROUP BY 1, 2 HAVING CAST(floor(min(t) / 10800000) * 10800000 AS BIGINT) + 10800000 <= (SELECT max(t) FROM samples) - 15000")
def streamed_switches(spark, d):
    """TS6: one snapshot of the opening quote for each cycle that has been switched from."""
    return run_to_end(spark, d, windows.switches, "series long, cycle_ts long, open_q double").withColumn("open_q", F.round("open_q", 6))


@query(f"WITH {SAMPLES_SQL} SELECT DISTINCT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start FROM samples WHERE q >= 0.69 AND q < 0.75")
def streamed_boxes(spark, d):
    """TS11: the windows in which a quote entered the rule's box, each announced once."""
    out = run_to_end(spark, d, lambda s: windows.fire_once(s, 0.69, 0.75).select("series", F.unix_millis("start").alias("start")), "series long, start long")
    return out


_COOLED_SQL = f"""{SAMPLES_SQL}, a AS (SELECT series, event_type AS code, CASE WHEN event_type = 'error' THEN 3600000 ELSE 21600000 END AS silence, t FROM samples WHERE q >= 0.6 AND event_type IN ('error', 'signup')),
n AS (SELECT s.series, s.code, s.t, min(x.t) AS nt FROM a s LEFT JOIN a x ON s.series = x.series AND s.code = x.code AND x.t >= s.t + s.silence GROUP BY 1, 2, 3),
f(series, code, t) AS (SELECT series, code, min(t) FROM a GROUP BY 1, 2 UNION SELECT f.series, f.code, n.nt FROM f JOIN n ON f.series = n.series AND f.code = n.code AND f.t = n.t WHERE n.nt IS NOT NULL)"""


@query(f"WITH RECURSIVE {_COOLED_SQL} SELECT series, code, t AS sent_ts FROM f")
def streamed_alerts(spark, d):
    """PF18, TS10: alerts of a code that are sent: those that come after the silence of its level, which a keyed state holds."""
    return run_to_end(spark, d, windows.alerts, "series long, code string, sent_ts long")


@query(f"WITH {SAMPLES_SQL} SELECT series, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS start, round(arg_min(q, (t, event_id)), 6) AS entry FROM samples GROUP BY 1, 2 HAVING count(*) >= 10")
def streamed_triggers(spark, d):
    """TS2, TS3: the windows that a stream announced once they had ten samples, with their first price as entry; a window that
    is counted on is announced once, as the sink keeps the row it got first."""
    out = new_path(spark, "triggers")
    run_batches(spark, d, windows_at(10), windows.append_new(out, ["series", "start"]), "update")
    return spark.read.schema("series long, start long, entry double").parquet(out).withColumn("entry", F.round("entry", 6))


def windows_at(k: int):
    return lambda stream: detectors.announced(stream, k)


def event_stream(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(d)


def run_batches(spark, d, change, write, mode: str = "append"):
    """Give every batch of change(event stream) to `write`, until all files are read."""
    q = change(event_stream(spark, d)).writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, "state")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


@contextlib.contextmanager
def keyed_state(spark):
    """The store that states with several variables and timers need; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@query(f"WITH x AS ({ORACLE_SQL['confirmed_breaks']}) SELECT series, cycle_ts, side, status, tries, decided_ts FROM x WHERE status <> 'PENDING' AND decided_ts <= (SELECT max(epoch_us(ts) // 1000) - 15000 FROM events)")
def streamed_confirmations(spark, d):
    """TS8, TS9: pending breaks that a keyed state confirms, discards or gives up at cycle boundaries: what `confirmed_breaks`
    has decided by the time that the watermark reaches."""
    with keyed_state(spark):
        return run_to_end(spark, d, detectors.confirmations, "series long, cycle_ts long, side string, status string, tries int, decided_ts long")


@query(f"WITH {BARS_SQL}, x AS ({audits.COOLED_SQL}), m AS (SELECT max(t) - 15000 AS mark FROM samples) SELECT x.* FROM x, m WHERE signal_ts + 3600000 <= mark")
def streamed_cooled(spark, d):
    """TS10: signals with their cool-down and the daily cap over both sides of a series, from a keyed state; here those of bars
    that the watermark has passed."""
    with keyed_state(spark):
        out = run_to_end(spark, d, detectors.cooled, "series long, side string, signal_ts long, over_cap boolean")
    mark = src.samples(spark, d).agg((F.max("t") - 15_000).alias("mark"))
    return out.join(F.broadcast(mark), F.col("signal_ts") + src.HOUR_MS <= F.col("mark")).drop("mark")  # one row


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_ts, outcome, c, lag(c) OVER w AS pc, lag(bar_ts) OVER w AS pts, lead(bar_ts) OVER w AS nts, lead(outcome) OVER w AS no, lead(o) OVER w AS nq FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts))
SELECT series, bar_ts AS window_start, CASE WHEN pts = bar_ts - 3600000 AND abs(c / pc - 1) < 0.5 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN nts - bar_ts = 3600000 THEN 'SETTLED' ELSE 'EXPIRED' END AS status,
  CASE WHEN nts - bar_ts = 3600000 THEN no = 'DOWN' END AS win, CASE WHEN nts - bar_ts = 3600000 THEN round(CASE WHEN no = 'DOWN' THEN 0.98 / least(greatest(1 - nq + 0.01, 0.01), 0.99) - 1 ELSE -1 END, 6) END AS ev_at_entry
FROM x WHERE outcome = 'UP' AND c <= 0.4 AND bar_ts <= (SELECT max(bar_ts) FROM bars) - {6 * src.HOUR_MS}"""
)
def streamed_settlements(spark, d):
    """TS12, DP3: signals settled by their target window, or expired when the watermark has passed it, from joins of streams;
    those of the last six hours may still be pending and are left out."""
    b = src.bars(spark, d).select("series", "bar_ts", F.timestamp_millis("bar_ts").alias("ts"), "o", "c", "outcome")
    path, schema = new_path(spark, "windows"), b.schema
    b.write.parquet(path)
    out = run_to_end(spark, d, lambda _: detectors.settlements(lambda: spark.readStream.schema(schema).parquet(path)), "series long, window_start long, version string, status string, win boolean, target_open double")
    last = spark.read.schema(schema).parquet(path).agg((F.max("bar_ts") - 6 * src.HOUR_MS).alias("last"))
    out = out.join(F.broadcast(last), F.col("window_start") <= F.col("last"))  # one row
    return out.select("series", "window_start", "version", "status", "win", F.round(ev.realised(F.col("win"), 1 - F.col("target_open")), 6).alias("ev_at_entry"))


@query(f"WITH {BARS_SQL}, m AS (SELECT max(t) AS now FROM samples) SELECT series, bar_ts, n, round(c, 6) AS c FROM bars, m WHERE bar_ts + 3600000 <= now - 15000")
def polled_windows(spark, d):
    """TS7, TS14: closed windows polled above a high-water mark of each series, with a scan of the 12 before it, by batches that may
    run again without a row twice."""
    sink = detectors.HighWater(new_path(spark, "polled"), "series", "bar_ts", 12, src.HOUR_MS)
    run_batches(spark, d, windows.archive, sink)
    return sink.rows(spark).select("series", "bar_ts", "n", F.round("c", 6).alias("c"))
