"""Structured Streaming twins of the batch views: event-time windows, late data, fire-once rules, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.events import USERS_OF_SERIES


def quotes(events: DataFrame, *more: Column) -> DataFrame:
    q = F.least(F.greatest(F.col("value") / 100, F.lit(0.01)), F.lit(0.99))
    return events.select("event_id", F.floor(F.col("user_id") / USERS_OF_SERIES).alias("series"), F.col("ts").cast("timestamp").alias("ts"), q.alias("q"), *more)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream with the schema of the files at path."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def archive(stream: DataFrame, width: str = "1 hour", grace: str = "15 seconds") -> DataFrame:
    """TS4: closed tumbling windows once the watermark has passed them; later rows are dropped."""
    w = quotes(stream).withWatermark("ts", grace).groupBy("series", F.window("ts", width))
    point = F.struct("ts", "event_id")
    g = w.agg(F.count("*").alias("n"), F.min_by("q", point).alias("o"), F.max_by("q", point).alias("c"), F.max("q").alias("h"), F.min("q").alias("l"))
    return g.select("series", F.unix_millis(F.col("window.start")).alias("bar_ts"), "n", "o", "h", "l", "c")


def ticks(stream: DataFrame, width: str = "3 minutes", grace: str = "15 seconds") -> DataFrame:
    """TS1: the last quote of each aligned tick."""
    g = quotes(stream).withWatermark("ts", grace).groupBy("series", F.window("ts", width)).agg(F.count("*").alias("n"), F.max_by("q", F.struct("ts", "event_id")).alias("q"))
    return g.select("series", F.unix_millis(F.col("window.start")).alias("tick_ts"), "n", "q")


def switches(stream: DataFrame, width: str = "3 hours", grace: str = "15 seconds") -> DataFrame:
    """TS6: the opening quote of each cycle, once, when the cycle is over."""
    g = quotes(stream).withWatermark("ts", grace).groupBy("series", F.window("ts", width)).agg(F.min_by("q", F.struct("ts", "event_id")).alias("open_q"))
    return g.select("series", F.unix_millis(F.col("window.start")).alias("cycle_ts"), "open_q")


def alerts(stream: DataFrame, grace: str = "1 hour") -> DataFrame:
    """PF18, TS10: alerts by series and code; one is sent only after the silence of its level since the last one sent.

    The state of a key is one time. A batch's rows of a key are taken in order of time.
    """
    rows = quotes(stream, F.col("event_type").alias("code")).filter((F.col("q") >= 0.6) & F.col("code").isin("error", "signup")).withWatermark("ts", grace).select("series", "code", F.unix_millis("ts").alias("t"), "ts")

    def send(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        silence = 3_600_000 if key[1] == "error" else 21_600_000
        last = state.get[0] if state.exists else None
        sent = []
        for t in sorted(x for p in parts for x in p["t"].tolist()):
            if last is None or t >= last + silence:
                sent.append(t)
                last = t
        if last is not None:
            state.update((last,))
        if sent:
            yield pd.DataFrame({"series": [key[0]] * len(sent), "code": [key[1]] * len(sent), "sent_ts": sent})

    return rows.groupBy("series", "code").applyInPandasWithState(send, "series long, code string, sent_ts long", "last long", "append", GroupStateTimeout.NoTimeout)


def fire_once(stream: DataFrame, low: float, high: float, grace: str = "1 hour") -> DataFrame:
    """TS11: the first sample of a series and hour inside a quote box, whatever follows."""
    hit = quotes(stream).filter((F.col("q") >= low) & (F.col("q") < high)).withColumn("start", F.date_trunc("hour", "ts"))
    return hit.withWatermark("ts", grace).dropDuplicatesWithinWatermark(["series", "start"])


def trigger_at(stream: DataFrame, k: int = 10, grace: str = "1 hour") -> DataFrame:
    """TS2, TS3: a series' window, once, as soon as it has k samples.

    The state is one count a window, and goes when the watermark passes the window's end.
    """
    hour = F.window("ts", "1 hour")
    rows = quotes(stream).withWatermark("ts", grace).select("series", F.unix_millis(hour.start).alias("start"), F.unix_millis(hour.end).alias("end"), "ts")

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        after = before + sum(len(p) for p in parts)
        state.update((after,))
        state.setTimeoutTimestamp(max(int(key[2]), state.getCurrentWatermarkMs() + 1))
        if before < k <= after:
            yield pd.DataFrame({"series": [key[0]], "start": [key[1]]})

    return rows.groupBy("series", "start", "end").applyInPandasWithState(count, "series long, start long", "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def append_new(path: str, keys: list[str], by: str | None = None) -> Callable[[DataFrame, int], None]:
    """SC9, SC13, TS7, TS14: a foreachBatch sink that appends only keys the table does not hold yet.

    by: the column that partitions the table; then a batch reads the keys of its own partitions only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            known = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            if by:
                parts = [r[0] for r in batch.select(by).distinct().collect()]  # a batch's partitions, not its rows
                known = known.filter(F.col(by).isin(parts))
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        out = fresh.write.mode("append")
        (out.partitionBy(by) if by else out).parquet(path)

    return write
