"""Streams over many small batches, with late rows and restarts, against the batch queries on the same events."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.plans import audits, detection, streams
from tidemark.sources import events as src
from tidemark.streaming import detectors
from tidemark.streaming.windows import read_stream

T0, HOUR = 1_704_067_200_000, 3_600_000
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def made(seed=5, days=16):
    """(t, event_id, user_id, code, value): three series, quiet quotes with spikes, hours and cycles without a sample."""
    rng, rows, k = random.Random(seed), [], 0
    for series in range(3):
        for h in range(days * 24):
            if rng.random() < 0.25 or h // 3 % 9 == series:
                continue
            for _ in range(rng.randint(1, 4)):
                spike = 30 if rng.random() < 0.06 else 0
                rows.append((T0 + h * HOUR + rng.randrange(HOUR), k, 40 * series + rng.randrange(40), rng.choice(["error", "error", "click"]), 45 + rng.gauss(0, 4) + rng.choice([-1, 1]) * spike))
                k += 1
    return sorted(rows)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, u, c, v, None) for t, k, u, c, v in rows], "event_id long, t long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_millis("t")).select("event_id", "ts", "user_id", "event_type", "value", "props")


@pytest.fixture(scope="module")
def parts():
    """Files in time order with rows out of order by less than the grace, and rows that come too late."""
    rows = made()
    rng = random.Random(1)
    rows.sort(key=lambda r: r[0] + rng.randrange(HOUR // 2))
    size = len(rows) // 6 + 1
    files = [rows[at : at + size] for at in range(0, len(rows), size)]
    late = [(files[0][5][0] + 1000 * k, 900_000 + k, 3, "click", 99.0) for k in range(20)]
    return files, late


@pytest.fixture(scope="module")
def on_time(spark, parts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    frame(spark, [r for f in parts[0] for r in f]).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def run(spark, stream, tmp, schema):
    q = stream.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{tmp}/out")


def fed(spark, parts, tmp, change, schema):
    """Half of the files, a run to its end, the other half with the late rows, and a second run from the checkpoint."""
    files, late = parts
    half = len(files) // 2
    for k, f in enumerate(files):
        if k == half:
            run(spark, change(read_stream(spark, f"{tmp}/in")), tmp, schema)
            frame(spark, late).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        frame(spark, f).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        time.sleep(0.05)
    return run(spark, change(read_stream(spark, f"{tmp}/in")), tmp, schema)


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_confirmations(spark, parts, on_time, tmp_path):
    schema = "series long, cycle_ts long, side string, status string, tries int, decided_ts long"
    with streams.keyed_state(spark):
        got = fed(spark, parts, str(tmp_path), lambda s: detectors.confirmations(s, "1 hour"), schema)
    mark = max(r[0] for f in parts[0] for r in f) - HOUR
    want = audits.confirmed_breaks(spark, on_time).filter(F.col("decided_ts") <= mark)
    names = [c.split()[0] for c in schema.split(", ")]
    assert rows_of(got, *names) == rows_of(want, *names)
    seen = {(r.status, r.tries) for r in got.collect()}
    assert {s for s, _ in seen} == {"CONFIRM", "DISCARD", "TIMEOUT"} and ("TIMEOUT", 5) in seen and any(s == "CONFIRM" and n > 1 for s, n in seen)
    # the broader view has the same gaps
    plain = {(r.series, r.cycle_ts, r.side): r.status for r in audits.breaks_at_boundary(spark, on_time).collect()}
    assert all((r.status == "DISCARD") == (plain[r.series, r.cycle_ts, r.side] == "DISCARD") for r in got.collect())


def test_cooled_with_a_cap_of_the_day(spark, parts, on_time, tmp_path, monkeypatch):
    schema = "series long, side string, signal_ts long, over_cap boolean"
    monkeypatch.setattr(audits, "DAILY_CAP", 2)

    class Capped(detectors.Cooled):
        def signal(self, state, side, t):
            return [(s, at, state["sent"] >= 2) for s, at, _ in super().signal(state, side, t)]

    with streams.keyed_state(spark):
        got = fed(spark, parts, str(tmp_path), lambda s: detectors._ordered(s, Capped(), schema, "1 hour"), schema)
    mark = max(r[0] for f in parts[0] for r in f) - HOUR
    want = audits.cooled_signals(spark, on_time)
    names = ["series", "side", "signal_ts", "over_cap"]
    closed = F.col("signal_ts") + HOUR <= mark
    assert rows_of(got.filter(closed), *names) == rows_of(want.filter(closed), *names)
    assert {r.over_cap for r in got.collect()} == {True, False}


def test_settlements(spark, on_time, tmp_path):
    bars = src.bars(spark, on_time).withColumn("ts", F.timestamp_millis("bar_ts")).select("series", "bar_ts", "ts", "o", "c", "outcome").orderBy("bar_ts").toPandas()
    last = int(bars["bar_ts"].max())
    schema = "series long, bar_ts long, ts timestamp, o double, c double, outcome string"
    # every window of the last day stands in the table, so that no signal of the batch query waits for its series
    for k in range(5):
        some = bars[(bars["bar_ts"] >= T0 + k * (last - T0 + 1) // 5) & (bars["bar_ts"] < T0 + (k + 1) * (last - T0 + 1) // 5)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = detectors.settlements(lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = run(spark, stream, str(tmp_path), "series long, window_start long, version string, status string, win boolean, target_open double")
    want = detection.shadow_signals(spark, on_time).filter((F.col("status") != "PENDING") & (F.col("window_start") <= last - 24 * HOUR))
    names = ["series", "window_start", "version", "status", "win"]
    mine = rows_of(got.filter(F.col("window_start") <= last - 24 * HOUR), *names)
    assert mine == rows_of(want, *names) and {r[3] for r in mine} == {"SETTLED", "EXPIRED"} and {r[2] for r in mine} == {"v1", "v2"}


class Torn(detectors.HighWater):
    """Fails once between the rows and the marks of a batch."""

    torn = False

    def __call__(self, batch, batch_id):
        if batch_id == 2 and not Torn.torn:
            Torn.torn = True
            batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
            raise RuntimeError("torn")
        super().__call__(batch, batch_id)


def test_polled_windows_after_a_torn_batch(spark, parts, on_time, tmp_path):
    from tidemark.streaming import windows

    for f in parts[0]:
        frame(spark, f).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    sink = Torn(f"file://{tmp_path}/table", "series", "bar_ts", 12, HOUR)
    for attempt in range(2):
        q = windows.archive(read_stream(spark, f"{tmp_path}/in"), grace="1 hour").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        if attempt:
            q.awaitTermination()
        else:
            with pytest.raises(Exception, match="torn"):
                q.awaitTermination()
    mark = max(r[0] for f in parts[0] for r in f) - HOUR
    want = src.bars(spark, on_time).filter(F.col("bar_ts") + HOUR <= mark)
    assert rows_of(sink.rows(spark), "series", "bar_ts", "n") == rows_of(want, "series", "bar_ts", "n")


def test_back_scan_and_repeated_batches(spark, tmp_path):
    sink = detectors.HighWater(f"file://{tmp_path}/table", "series", "bar_ts", 12, 10)
    batch = lambda *rows: spark.createDataFrame(list(rows), "series long, bar_ts long")
    sink(batch((1, 200), (1, 200), (2, 50)), 0)
    second = batch((1, 210), (1, 190), (1, 81), (1, 80), (1, 200), (3, 5))  # 81 is within 12 windows of the mark, 80 is not
    for _ in range(2):
        sink(second, 1)
    sink(batch(), 2)
    sink(batch((2, 60), (2, 50), (3, 4)), 3)
    assert rows_of(sink.rows(spark), "series", "bar_ts") == sorted([(1, 200), (2, 50), (1, 210), (1, 190), (1, 81), (3, 5), (2, 60), (3, 4)], key=repr)


def test_announced_once_with_the_first_price(spark, tmp_path):
    rows = [(T0 + 60_000 * (10 + k), k, 1, "click", 40.0 + k) for k in range(12)]
    for at in (0, 4, 8):
        frame(spark, rows[at : at + 4]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    from tidemark.streaming.windows import append_new

    out = f"file://{tmp_path}/out"
    q = detectors.announced(read_stream(spark, f"{tmp_path}/in"), 6).writeStream.foreachBatch(append_new(out, ["series", "start"])).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(0, T0, 0.4)]
