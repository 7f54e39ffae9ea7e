"""Queries of health: phases with their costs, predictions and windows, alert rows; time left; first hits with their context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.shared import written
from tidemark.plans import audits
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL, HOUR_MS, SAMPLES_SQL

DAY_MS = 24 * HOUR_MS
# Phases in their order, of which the last never runs here, and the kinds of events that stand for them.
PHASES = ("PREDICT", "VALIDATE", "LEARN", "EVOLVE", "ARCHIVE")
_KINDS = {"click": "PREDICT", "view": "VALIDATE", "purchase": "LEARN", "error": "EVOLVE"}
# Prices of a million tokens, share that a missing completion is of its prompt, characters of a token.
PRICE_IN, PRICE_OUT, OUT_SHARE, CHARS = 1.0, 2.0, 0.3, 4
# Fixed values of the alerts: seconds after which windows and predictions are stale, failures in a row, success rate, depth, cost of a day.
STALE_S, FAILURES, LEAST_RATE, DEEP, COST_CAP = 900.0, 3, 0.8, 5, 0.02
#: Predictions and windows that a report looks back on.
RECENT_PREDICTIONS, RECENT_WINDOWS = 20, 60
_PHASE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in _KINDS.items()) + " END"
# Token counts that were not recorded are null: prompts below 20, completions of calls below 10.
_PROMPT, _COMPLETION = "CASE WHEN k >= 20 THEN k END", "CASE WHEN value >= 10 THEN CAST(floor(value) AS BIGINT) END"

RUNS_SQL = f"""calls AS (SELECT {_PHASE_SQL} AS phase, event_id, epoch_us(ts) // 1000 AS t, value > 30 AS ok, {_PROMPT} AS prompt, {_COMPLETION} AS completion, CAST(ceil(length(props) / {CHARS}.0) AS BIGINT) AS guess FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
runs AS (SELECT phase, event_id, t, ok, prompt IS NULL AS guessed, coalesce(prompt, guess) AS prompt, coalesce(completion, greatest(1, CAST(floor(coalesce(prompt, guess) * {OUT_SHARE}) AS BIGINT))) AS completion FROM calls WHERE phase IS NOT NULL),
clock AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)"""


def runs(spark, d):
    """Calls of a phase in order of (t, event_id): success, prompt and completion tokens, estimated where they were not recorded."""
    e = src.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    phase = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("event_type")]
    guess = F.ceil(F.length("props") / CHARS)
    prompt = F.expr(_PROMPT)
    e = e.select(phase.alias("phase"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") > 30).alias("ok"), prompt.isNull().alias("guessed"), F.coalesce(prompt, guess).alias("prompt"), F.expr(_COMPLETION).alias("completion"))
    return e.filter("phase IS NOT NULL").withColumn("completion", F.coalesce("completion", F.greatest(F.lit(1), F.floor(F.col("prompt") * OUT_SHARE))))


def trailing(rows, key: str, bucket: Column):
    """AG12: for each key how many rows follow its last success, by runs of buckets that can be merged in any order.

    A bucket is summed up by its rows and by those after its own last success; the run of a key is what follows in its last
    bucket with a success, and all rows of the buckets after it. No task sorts or holds the rows of a key.
    """
    at = F.struct("t", "event_id")
    rows = rows.withColumn("bucket", bucket)
    last = rows.filter("ok").groupBy(key, "bucket").agg(F.max(at).alias("last_ok"))
    after = rows.join(last, [key, "bucket"], "left").groupBy(key, "bucket").agg(F.count_if(F.col("last_ok").isNull() | (at > F.col("last_ok"))).alias("run"), F.max("last_ok").isNotNull().alias("has_ok"))
    newest = after.groupBy(key).agg(F.max(F.when(F.col("has_ok"), F.col("bucket"))).alias("newest"))
    return after.join(newest, key).filter(F.col("newest").isNull() | (F.col("bucket") >= F.col("newest"))).groupBy(key).agg(F.sum("run").alias("failures"))


_REPORT_SQL = f"""{RUNS_SQL}, g AS (SELECT phase, count(*) AS total, count(*) FILTER (ok) AS good, max(t) FILTER (ok) AS ok_t, max(t) FILTER (NOT ok) AS bad_t, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens, count(*) FILTER (guessed) AS guessed, sum(prompt * {PRICE_IN}::DOUBLE + completion * {PRICE_OUT}::DOUBLE) / 1000000 AS cost FROM runs GROUP BY 1),
f AS (SELECT phase, count(*) AS failures FROM runs r LEFT JOIN (SELECT phase, max((t, event_id)) AS last FROM runs WHERE ok GROUP BY 1) l USING (phase) WHERE last IS NULL OR (t, event_id) > last GROUP BY 1),
report AS (SELECT p.phase, CAST(place AS INTEGER) AS place, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN good / total END AS rate, coalesce(failures, 0) AS failures, (now - ok_t) / 1000.0::DOUBLE AS age_s, bad_t AS last_failure_ts, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(guessed, 0) AS guessed, coalesce(cost, 0) AS cost
  FROM (SELECT unnest({list(PHASES)}) AS phase, unnest(range({len(PHASES)})) AS place) p LEFT JOIN g USING (phase) LEFT JOIN f USING (phase), clock)"""


def report(spark, d):
    """One row for each phase of the fixed list, with zeros and nulls for one that never ran."""
    r = written(runs(spark, d), "runs")
    now = src.table(spark, d, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("now"))
    g = r.groupBy("phase").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("good"), F.max(F.when(F.col("ok"), F.col("t"))).alias("ok_t"), F.max(F.when(~F.col("ok"), F.col("t"))).alias("bad_t"), F.sum("prompt").alias("prompt_tokens"),
        F.sum("completion").alias("completion_tokens"), F.count_if("guessed").alias("guessed"), (F.sum(F.col("prompt") * PRICE_IN + F.col("completion") * PRICE_OUT) / 1_000_000).alias("cost"),
    )
    f = trailing(r, "phase", F.floor(F.col("t") / HOUR_MS))
    fixed = spark.createDataFrame(list(enumerate(PHASES)), "place int, phase string")
    x = fixed.join(g, "phase", "left").join(f, "phase", "left").join(F.broadcast(now))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select(
        "phase", "place", zero("total"), (F.col("good") / F.nullif(F.col("total"), F.lit(0))).alias("rate"), zero("failures"), ((F.col("now") - F.col("ok_t")) / 1000).alias("age_s"), F.col("bad_t").alias("last_failure_ts"),
        zero("prompt_tokens"), zero("completion_tokens"), zero("guessed"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
    ), r, now


@query(f"WITH {_REPORT_SQL} SELECT phase, place, total, round(rate, 6) AS success_rate, failures AS failures_in_a_row, round(age_s, 1) AS age_s, last_failure_ts, prompt_tokens, completion_tokens, guessed, round(cost, 9) AS cost FROM report")
def phase_report(spark, d):
    """AG11, AG12, AG39, AG41: each phase of the fixed list: calls, success rate, failures in a row, seconds since the last success
    (null if never), last failure, tokens (estimated from the text or as a share of the prompt where not recorded) and cost."""
    x, _, _ = report(spark, d)
    return x.select("phase", "place", "total", r6("rate").alias("success_rate"), F.col("failures").alias("failures_in_a_row"), F.round("age_s", 1).alias("age_s"), "last_failure_ts", "prompt_tokens", "completion_tokens", "guessed", F.round("cost", 9).alias("cost"))


_RECENT_SQL = f"""newest AS (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT {RECENT_PREDICTIONS}),
stats AS (SELECT count(*) AS total, count(*) FILTER (user_id % 3 = 0) AS matched, count(*) FILTER (value > 60) AS n_up, count(*) FILTER (value < 25) AS n_down, count(*) FILTER (value BETWEEN 25 AND 60) AS n_no_trade FROM newest),
hours AS (SELECT DISTINCT epoch_us(ts) // 3600000000 * 3600000 AS start FROM events WHERE event_type = 'error' ORDER BY 1 DESC LIMIT {RECENT_WINDOWS}),
gaps AS (SELECT max(start) AS last_start, coalesce(CAST(sum(CASE WHEN gap > 1.5 * 3600000 THEN round_even(gap / 3600000.0, 0) - 1 ELSE 0 END) AS BIGINT), 0) AS gap_count FROM (SELECT start, start - lag(start) OVER (ORDER BY start) AS gap FROM hours)),
depth AS (SELECT count(*) AS depth FROM runs, clock WHERE NOT ok AND t > now - 3600000),
health AS (SELECT stats.*, (now - last_start) / 1000.0::DOUBLE AS window_age_s, gap_count, depth FROM stats, gaps, depth, clock)"""


def recent(spark, d, r, now):
    """One row: the newest predictions by direction and match, the newest windows with their gaps, failed calls of the last hour."""
    e = src.table(spark, d, "events")
    p = e.filter("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(RECENT_PREDICTIONS)
    v = F.col("value")
    s = p.agg(F.count("*").alias("total"), F.count_if(F.col("user_id") % 3 == 0).alias("matched"), F.count_if(v > 60).alias("n_up"), F.count_if(v < 25).alias("n_down"), F.count_if((v >= 25) & (v <= 60)).alias("n_no_trade"))
    start = src.bucket(F.unix_millis(F.col("ts").cast("timestamp")), HOUR_MS)
    starts = e.filter("event_type = 'error'").select(start.alias("start")).distinct().orderBy(F.desc("start")).limit(RECENT_WINDOWS)
    # the newest windows, a bounded number of them, in one array
    a = starts.agg(F.array_sort(F.collect_list("start")).alias("a"))
    steps = F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.get("a", i) - F.get("a", i - 1))
    missed = F.aggregate(F.when(F.size("a") > 1, steps).otherwise(F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda x, g: x + F.when(g > 1.5 * HOUR_MS, F.bround(g / HOUR_MS).cast("long") - 1).otherwise(0))
    g = a.select(F.array_max("a").alias("last_start"), missed.alias("gap_count"))
    deep = r.join(F.broadcast(now)).filter(~F.col("ok") & (F.col("t") > F.col("now") - HOUR_MS)).agg(F.count("*").alias("depth"))
    one = s.join(F.broadcast(g)).join(F.broadcast(deep)).join(F.broadcast(now))  # one row each
    return one.withColumn("window_age_s", (F.col("now") - F.col("last_start")) / 1000).drop("now", "last_start")


@query(f"WITH {RUNS_SQL}, {_RECENT_SQL} SELECT total, matched, CASE WHEN total > 0 THEN round(matched / total, 4) ELSE 0.0 END AS match_rate, n_up, n_down, n_no_trade, round(window_age_s, 1) AS window_age_s, gap_count, depth FROM health")
def prediction_stats(spark, d):
    """AG8, DP30, WF31: match rate and directions of the 20 newest predictions, with all three directions whatever occurs, age and gaps
    of the 60 newest windows, depth of the queue (both numbers are the report's)."""
    _, r, now = report(spark, d)
    h = recent(spark, d, r, now)
    return h.select("total", "matched", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 4)).otherwise(0.0).alias("match_rate"), "n_up", "n_down", "n_no_trade", F.round("window_age_s", 1).alias("window_age_s"), "gap_count", "depth")


# Alerts of the whole: code, level, value, threshold, whether it is given, whether it blocks trades.
_WHOLE = (
    ("WINDOW_STALE", "CRITICAL", "window_age_s", STALE_S, f"window_age_s > {STALE_S}", False), ("WINDOW_GAP", "WARN", "gap_count", 0.0, "gap_count > 0", False),
    ("NO_MATCH", "WARN", "matched", 0.0, "total > 0 AND matched = 0", False), ("QUEUE_DEEP", "WARN", "depth", float(DEEP), f"depth >= {DEEP}", False), ("COST_LIMIT", "CRITICAL", "day_cost", COST_CAP, f"day_cost >= {COST_CAP}", True),
)
_OF_PHASE = (
    ("PREDICT_STALE", "CRITICAL", "age_s", 2 * 3600.0, "phase = 'PREDICT' AND age_s > 7200", False), ("CALL_FAILURES", "CRITICAL", "failures", float(FAILURES), f"failures >= {FAILURES}", True),
    ("ERROR_RATE", "WARN", "rate", LEAST_RATE, f"total > 0 AND rate < {LEAST_RATE}", False),
)


def _alerts_sql(rules: tuple, table: str, phase: str) -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, '{level}' AS level, {phase} AS phase, CAST({value} AS DOUBLE) AS value, CAST({limit} AS DOUBLE) AS threshold, {blocks} AS blocks FROM {table} WHERE {when}" for code, level, value, limit, when, blocks in rules)


@query(
    f"""WITH {_REPORT_SQL}, {_RECENT_SQL}, today AS (SELECT coalesce(sum(prompt * {PRICE_IN}::DOUBLE + completion * {PRICE_OUT}::DOUBLE), 0) / 1000000 AS day_cost FROM runs, clock WHERE t // {DAY_MS} = now // {DAY_MS}), one AS (SELECT * FROM health, today),
a AS ({_alerts_sql(_WHOLE, 'one', "''")} UNION ALL {_alerts_sql(_OF_PHASE, 'report', 'phase')})
SELECT code, level, phase, round(value, 6) AS value, threshold, blocks, CASE WHEN bool_or(level = 'CRITICAL') OVER () THEN 'CRITICAL' ELSE 'WARN' END AS overall, bool_or(blocks) OVER () AS trading_blocked FROM a"""
)
def alert_rows(spark, d):
    """DP30, DP32, AG12: one row for each alert that holds: stale or missing windows, no match, stale predictions, depth of the queue, cost of
    the UTC day, failures in a row and success rate of each phase; with the overall level and whether any of them blocks trades."""
    x, r, now = report(spark, d)
    x = written(x, "report")
    today = F.floor(F.col("t") / DAY_MS) == F.floor(F.col("now") / DAY_MS)
    cost = r.join(F.broadcast(now)).filter(today).agg((F.coalesce(F.sum(F.col("prompt") * PRICE_IN + F.col("completion") * PRICE_OUT), F.lit(0.0)) / 1_000_000).alias("day_cost"))
    one = recent(spark, d, r, now).join(F.broadcast(cost))  # one row each

    def given(df, rules: tuple, phase: Column):
        cells = F.array(*(F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), phase.alias("phase"), F.col(value).cast("double").alias("value"), F.lit(limit).alias("threshold"), F.lit(blocks).alias("blocks"))) for code, level, value, limit, when, blocks in rules))
        return df.select(F.inline(F.filter(cells, lambda c: c.isNotNull())))

    a = written(given(one, _WHOLE, F.lit("")).unionByName(given(x, _OF_PHASE, F.col("phase"))), "alerts")  # at most 20 rows
    whole = a.agg(F.when(F.max(F.col("level") == "CRITICAL"), "CRITICAL").otherwise("WARN").alias("overall"), F.max("blocks").alias("trading_blocked"))
    return a.join(F.broadcast(whole)).select("code", "level", "phase", r6("value").alias("value"), "threshold", "blocks", "overall", "trading_blocked")


#: Thirty seconds of five minutes are twelve times as long in an hour.
LEFT_MS = 360_000


@query(f"WITH {SAMPLES_SQL} SELECT event_id, series, CAST(3600000 - t % 3600000 AS BIGINT) AS left_ms, 3600000 - t % 3600000 < {LEFT_MS} AS stale FROM samples WHERE event_type = 'click'")
def time_left(spark, d):
    """PF12: how long each prediction's window still runs, and whether it is too late to act on it."""
    left = F.lit(HOUR_MS) - F.col("t") % HOUR_MS
    return src.samples(spark, d).filter("event_type = 'click'").select("event_id", "series", left.cast("long").alias("left_ms"), (left < LEFT_MS).alias("stale"))


# The cell of minutes and quotes in which the first hit counts, bars of the context, bars that a streak looks back on.
CELL_MS, CELL_Q, CONTEXT, LOOK_BACK = (10 * 60_000, 45 * 60_000), (0.2, 0.6), 12, 8
_BP = "round({} * 10000, 6)"


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, bar_ts - lag(bar_ts, {CONTEXT + 1}) OVER w AS span, {', '.join(f"lag(o, {k}) OVER w AS o{k}, lag(c, {k}) OVER w AS c{k}" for k in range(1, CONTEXT + 1))} FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_ts)),
h AS (SELECT series, t, q, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS bar_ts, row_number() OVER (PARTITION BY series, floor(t / 3600000) ORDER BY t, event_id) AS rn FROM samples WHERE t % 3600000 >= {CELL_MS[0]} AND t % 3600000 < {CELL_MS[1]} AND q >= {CELL_Q[0]} AND q < {CELL_Q[1]}),
e AS (SELECT h.series, h.t, h.q, x.*, greatest({', '.join(f'c{k}' for k in range(1, CONTEXT + 1))}) AS hi, least({', '.join(f'c{k}' for k in range(1, CONTEXT + 1))}) AS lo, ({' + '.join(f'abs(c{k} - o{k}) / o{k}' for k in range(1, CONTEXT + 1))}) / {CONTEXT} AS vol,
  list_position([{', '.join(f'(c{k} > o{k}) <> (c1 > o1)' for k in range(1, LOOK_BACK + 1))}], true) AS turn FROM h JOIN x ON h.series = x.series AND h.bar_ts = x.bar_ts WHERE rn = 1 AND span = {(CONTEXT + 1) * HOUR_MS})
SELECT series, t, round(q, 6) AS q, c < o AS win, {_BP.format('ln(q / o)')} AS depth, round(abs(q - 0.5) * 100, 6) AS q_depth, (q > 0.5) = (q < o) AS agree, {_BP.format('ln(c1 / o1)')} AS prev_ret, {_BP.format('ln(c2 / o2)')} AS prev2_ret, c1 > o1 AS prev_up,
  CAST(CASE WHEN c1 > o1 THEN 1 ELSE -1 END * CASE WHEN coalesce(turn, 0) > 0 THEN turn - 1 ELSE {LOOK_BACK} END AS INTEGER) AS streak, CASE WHEN hi > lo THEN round((o - lo) / (hi - lo), 6) ELSE 0.5 END AS pos12, {_BP.format('vol')} AS vol12, CAST(t // 3600000 % 24 AS INTEGER) AS hour FROM e"""
)
def cell_events(spark, d):
    """TB8: the first hit of a window inside a cell of time and quote, with what the 12 bars before it say; events without all of them are
    left out.

    Bars go to the day that they lie in and to the next one where its first bars look back on them, so an event finds its context
    in one array of at most 37 bars by series and day: no window over a series.
    """
    b = src.bars(spark, d).select("series", "bar_ts", "o", "c")
    reach = (CONTEXT + 1) * HOUR_MS
    days = F.array_distinct(F.array(F.floor(F.col("bar_ts") / DAY_MS), F.floor((F.col("bar_ts") + reach) / DAY_MS)))
    context = b.withColumn("day", F.explode(days)).groupBy("series", "day").agg(F.array_sort(F.collect_list(F.struct("bar_ts", "o", "c"))).alias("bars"))
    s = src.samples(spark, d).withColumns({"bar_ts": src.bucket(F.col("t"), HOUR_MS), "in_bar": F.col("t") % HOUR_MS})
    hit = (F.col("in_bar") >= CELL_MS[0]) & (F.col("in_bar") < CELL_MS[1]) & (F.col("q") >= CELL_Q[0]) & (F.col("q") < CELL_Q[1])
    first = s.filter(hit).groupBy("series", "bar_ts").agg(F.min_by(F.struct("t", "q"), F.struct("t", "event_id")).alias("e"))
    e = first.select("series", "bar_ts", "e.t", "e.q", F.floor(F.col("bar_ts") / DAY_MS).alias("day")).join(context, ["series", "day"]).join(b, ["series", "bar_ts"])
    # newest first, so that place 0 is the bar before
    before = F.reverse(F.filter("bars", lambda x: (x["bar_ts"] < F.col("bar_ts")) & (x["bar_ts"] >= F.col("bar_ts") - reach)))
    e = e.withColumn("p", before).filter(F.size("p") == CONTEXT + 1).withColumn("p", F.slice("p", 1, CONTEXT))
    of = lambda k, c: F.get("p", F.lit(k))[c]
    closes = F.transform("p", lambda x: x["c"])
    up = of(0, "c") > of(0, "o")
    turn = F.array_position(F.transform(F.slice("p", 1, LOOK_BACK), lambda x: (x["c"] > x["o"]) != up), True)
    hi, lo = F.array_max(closes), F.array_min(closes)
    vol = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.abs(x["c"] - x["o"]) / x["o"]) / CONTEXT
    bp = lambda c: F.round(c * 10_000, 6)
    return e.select(
        "series", "t", r6("q").alias("q"), (F.col("c") < F.col("o")).alias("win"), bp(F.log(F.col("q") / F.col("o"))).alias("depth"), F.round(F.abs(F.col("q") - 0.5) * 100, 6).alias("q_depth"), ((F.col("q") > 0.5) == (F.col("q") < F.col("o"))).alias("agree"),
        bp(F.log(of(0, "c") / of(0, "o"))).alias("prev_ret"), bp(F.log(of(1, "c") / of(1, "o"))).alias("prev2_ret"), up.alias("prev_up"), (F.when(up, 1).otherwise(-1) * F.when(turn > 0, turn - 1).otherwise(LOOK_BACK)).cast("int").alias("streak"),
        F.when(hi > lo, r6((F.col("o") - lo) / (hi - lo))).otherwise(0.5).alias("pos12"), bp(vol).alias("vol12"), (F.floor(F.col("t") / HOUR_MS) % 24).cast("int").alias("hour"),
    )


@query(audits.CAPPED_SQL)
def cooled_signals(spark, d):
    """TS10: signals of breaks that outlast the cool-down of their series and side; those over the cap of a UTC day, of all series
    together, are kept and marked."""
    return audits.capped_signals(audits.kept_signals(spark, d))
