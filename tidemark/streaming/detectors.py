"""Detectors as streams: pending breaks with confirmation, cooled signals with a daily cap, settlement, polled windows.

Rows may come in any order within the watermark's grace; later ones are dropped by Spark. What depends on
order waits in the state until the watermark has passed it and is then taken by time, so the same rows come out
however the input is cut into batches, and a run that is started again goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.events import HOUR_MS
from tidemark.streaming.windows import quotes

CYCLE_MS, DAY_MS = 3 * HOUR_MS, 24 * HOUR_MS
# Bars of a level, break margins, tries of a confirmation and how long after the boundary they go on.
LEVEL_BARS, ABOVE, BELOW, TRIES, CONFIRM_MS = 24, 1.0005, 0.9995, 5, 2 * HOUR_MS
#: Least time between two signals of a series and side, signals of a series and UTC day that are sent.
COOL_DOWN_MS, DAILY_CAP = 6 * HOUR_MS, 8


class Ordered(StatefulProcessor):
    """Rows (t, event_id, q, code) of a key, handed to `step` in order of (t, event_id) once the watermark has passed them.

    The state of a key is what `step` needs, as JSON of bounded size, and the rows that still wait. One timer for each
    key stands at its first waiting row.
    """

    columns: tuple[str, ...] = ()

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "json string")
        self.waiting = handle.getListState("waiting", "t long, event_id long, q double, code string")

    def _timer_at_first(self, rows: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part[["t", "event_id", "q", "code"]].itertuples(index=False)]
        if new:
            waiting = [tuple(r) for r in self.waiting.get()] + [(int(t), int(e), float(q), c) for t, e, q, c in new]
            self.waiting.put(waiting)
            self._timer_at_first(waiting)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()]
        state = json.loads(self.folded.get()[0]) if self.folded.exists() else self.start()
        out = []
        for row in sorted(r for r in waiting if r[0] <= mark):
            out += self.step(state, row)
        left = [r for r in waiting if r[0] > mark]
        self.folded.update((json.dumps(state),))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self._timer_at_first(left)
        if out:
            yield pd.DataFrame(out, columns=list(self.columns)).assign(series=key[0])[["series", *self.columns]]

    def close(self) -> None:
        pass


class Confirmations(Ordered):
    """TS8, TS9: breaks of the level of the 24 bars before wait for the boundary of their cycle, one for each side.

    At the next cycle's first sample they are discarded if a cycle was missed, else they are tried at each sample, five
    times at most and for CONFIRM_MS after the boundary; a sample whose code is 'error' is a try that fails.
    """

    columns = ("cycle_ts", "side", "status", "tries", "decided_ts")

    def start(self) -> dict:
        return {"closes": [], "bar": None, "close": None, "cycle": None, "pending": {}, "queue": []}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        t, _, q, code = row
        bar, cycle, out = t // HOUR_MS, t // CYCLE_MS * CYCLE_MS, []
        if bar != state["bar"]:
            if state["bar"] is not None:
                state["closes"] = (state["closes"] + [state["close"]])[-LEVEL_BARS:]
            state["bar"] = bar
        if state["cycle"] is not None and cycle != state["cycle"]:
            for side in sorted(state["pending"]):
                if cycle - state["cycle"] > CYCLE_MS:
                    out.append((state["cycle"], side, "DISCARD", 0, t))
                else:
                    state["queue"].append([state["cycle"], side, cycle, 0])
            state["pending"] = {}
        state["cycle"] = cycle
        again = []
        for item in state["queue"]:
            if t > item[2] + CONFIRM_MS:
                out.append((item[0], item[1], "TIMEOUT", item[3], t))
                continue
            item[3] += 1
            if code != "error":
                out.append((item[0], item[1], "CONFIRM", item[3], t))
            elif item[3] == TRIES:
                out.append((item[0], item[1], "TIMEOUT", item[3], t))
            else:
                again.append(item)
        state["queue"] = again
        if len(state["closes"]) == LEVEL_BARS:
            for side, broken in (("high", q > max(state["closes"]) * ABOVE), ("low", q < min(state["closes"]) * BELOW)):
                if broken:
                    state["pending"].setdefault(side, t)
        state["close"] = q
        return out


class Cooled(Ordered):
    """TS10: the first break of a side in a cycle is a signal if COOL_DOWN_MS have passed since the side's last one; those
    with DAILY_CAP before them in earlier bars of the series' UTC day, over both sides, are given and marked. The counter
    starts anew at midnight."""

    columns = ("side", "signal_ts", "over_cap")

    def start(self) -> dict:
        return {"closes": [], "bar": None, "close": None, "cycle": None, "broken": [], "last": {}, "day": None, "sent": 0, "now": 0}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        t, _, q, _ = row
        bar, cycle, out = t // HOUR_MS, t // CYCLE_MS, []
        if bar != state["bar"]:
            if state["bar"] is not None:
                state["closes"] = (state["closes"] + [state["close"]])[-LEVEL_BARS:]
            state["bar"], state["sent"], state["now"] = bar, state["sent"] + state["now"], 0
        if cycle != state["cycle"]:
            state["cycle"], state["broken"] = cycle, []
        if len(state["closes"]) == LEVEL_BARS:
            for side, broken in (("high", q > max(state["closes"]) * ABOVE), ("low", q < min(state["closes"]) * BELOW)):
                if broken and side not in state["broken"]:
                    state["broken"].append(side)
                    out += self.signal(state, side, bar * HOUR_MS)
        state["close"] = q
        return out

    def signal(self, state: dict, side: str, t: int) -> list[tuple]:
        if side in state["last"] and t - state["last"][side] < COOL_DOWN_MS:
            return []
        state["last"][side] = t
        if t // DAY_MS != state["day"]:
            state["day"], state["sent"], state["now"] = t // DAY_MS, 0, 0
        state["now"] += 1
        return [(side, t, state["sent"] >= DAILY_CAP)]


def _ordered(stream: DataFrame, processor: Ordered, schema: str, grace: str) -> DataFrame:
    rows = quotes(stream, F.col("event_type").alias("code")).withWatermark("ts", grace).withColumn("t", F.unix_millis("ts"))
    return rows.groupBy("series").transformWithStateInPandas(processor, schema, "append", "eventTime")


def confirmations(stream: DataFrame, grace: str = "15 seconds") -> DataFrame:
    return _ordered(stream, Confirmations(), "series long, cycle_ts long, side string, status string, tries int, decided_ts long", grace)


def cooled(stream: DataFrame, grace: str = "15 seconds") -> DataFrame:
    return _ordered(stream, Cooled(), "series long, side string, signal_ts long, over_cap boolean", grace)


def settlements(bars: Callable[[], DataFrame], grace: str = "1 hour") -> DataFrame:
    """TS12, DP3: a window that rises and ends low bets DOWN on the next one. Signals are joined with the window before (for
    the calm version) and with their target; a signal whose target has not come when the watermark has passed it is given
    without one: it has expired. The state holds the windows of the join's interval only.

    bars: gives a new stream of the windows (series, bar_ts, ts, o, c, outcome) each time.
    """

    def side(prefix: str, *names: str) -> DataFrame:
        return bars().select(F.col("ts").alias(f"{prefix}ts"), F.col("series").alias(f"{prefix}series"), *(F.col(n).alias(f"{prefix}{n}") for n in names)).withWatermark(f"{prefix}ts", grace)

    hour = F.expr("INTERVAL 1 HOUR")
    signals = side("", "bar_ts", "c", "outcome").filter((F.col("outcome") == "UP") & (F.col("c") <= 0.4)).drop("outcome")
    before, target = side("p_", "c"), side("n_", "o", "outcome")
    with_past = signals.join(before, (F.col("series") == F.col("p_series")) & (F.col("ts") == F.col("p_ts") + hour), "left")
    with_target = with_past.join(target, (F.col("series") == F.col("n_series")) & (F.col("n_ts") == F.col("ts") + hour), "left")
    calm = F.coalesce(F.abs(F.col("c") / F.col("p_c") - 1) < 0.5, F.lit(False))
    settled = F.col("n_ts").isNotNull()
    return with_target.select(
        "series", F.col("bar_ts").alias("window_start"), F.when(calm, "v2").otherwise("v1").alias("version"), F.when(settled, "SETTLED").otherwise("EXPIRED").alias("status"),
        F.when(settled, F.col("n_outcome") == "DOWN").alias("win"), F.col("n_o").alias("target_open"),
    )


class HighWater:
    """TS7: a foreachBatch sink that polls windows above a stored mark of each series and scans `back` windows below it.

    A batch writes its rows and its marks in folders named by its id and overwrites them when it is run again, so a batch
    that failed in the middle leaves no row twice and none out. Marks are one row a series.
    """

    def __init__(self, path: str, key: str, at: str, back: int, width: int):
        self.path, self.key, self.at, self.reach = path, key, at, back * width

    def _marks(self, spark, before: int):
        done = [int(p.getPath().getName().split("=")[1]) for p in self._folders(spark, f"{self.path}/marks")]
        last = max((b for b in done if b < before), default=None)
        return None if last is None else spark.read.parquet(f"{self.path}/marks/batch={last}")

    @staticmethod
    def _folders(spark, path: str) -> list:
        """The batches that have ended: their folders bear Spark's mark of success."""
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [p for p in fs.listStatus(jvm(path)) if fs.exists(jvm(f"{p.getPath()}/_SUCCESS"))] if fs.exists(jvm(path)) else []

    def rows(self, spark, before: int | None = None) -> DataFrame | None:
        parts = [p.getPath().toString() for p in self._folders(spark, f"{self.path}/rows") if before is None or int(p.getPath().getName().split("=")[1]) < before]
        return spark.read.option("basePath", f"{self.path}/rows").parquet(*parts).drop("batch") if parts else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([self.key, self.at])
        marks, known = self._marks(spark, batch_id), self.rows(spark, batch_id)
        fresh = batch
        if marks is not None:
            mark = f"{self.at}_mark"
            marks = marks.withColumnRenamed(self.at, mark)
            near = batch.join(marks, self.key, "left").filter(F.col(mark).isNull() | (F.col(self.at) > F.col(mark) - self.reach))
            fresh = near.filter(F.col(mark).isNull() | (F.col(self.at) > F.col(mark))).drop(mark)
            if known is not None:
                scanned = near.filter(F.col(self.at) <= F.col(mark)).drop(mark)
                lowest = scanned.agg(F.min(self.at)).first()[0]
                if lowest is not None:
                    held = known.filter(F.col(self.at) >= lowest).select(self.key, self.at)
                    fresh = fresh.unionByName(scanned.join(held, [self.key, self.at], "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        new = spark.read.schema(fresh.schema).parquet(f"{self.path}/rows/batch={batch_id}").groupBy(self.key).agg(F.max(self.at).alias(self.at))
        if marks is not None:
            new = new.unionByName(marks.withColumnRenamed(f"{self.at}_mark", self.at)).groupBy(self.key).agg(F.max(self.at).alias(self.at))
        new.write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")


def announced(stream: DataFrame, k: int = 10, grace: str = "1 hour", *more: Column) -> DataFrame:
    """TS2, TS3: windows with at least k samples, with the first price as entry: for update mode and a sink that keeps the
    row it got first. One count and one price a window, in the JVM."""
    g = quotes(stream, *more).withWatermark("ts", grace).groupBy("series", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.min_by("q", F.struct("ts", "event_id")).alias("entry"))
    return g.filter(F.col("n") >= k).select("series", F.unix_millis("window.start").alias("start"), "entry")


__all__ = ["Confirmations", "Cooled", "HighWater", "announced", "confirmations", "cooled", "settlements"]
