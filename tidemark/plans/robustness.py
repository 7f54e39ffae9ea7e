"""A hypothesis in four layers: random walk, what the market implies, its own record, and robustness with a permutation test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.bootstrap import _M1, _M2, _STEP, added, mixed, passed_on, passed_schema, seeds
from tidemark.operators.shared import written
from tidemark.plans.hypotheses import FEATURES_SQL, HYPOTHESES, features
from tidemark.plans.lifecycle import HALF
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources.events import HOUR_MS

#: Shuffles of the outcomes, length of the blocks inside which they are shuffled.
SHUFFLES, BLOCK_MS = 500, 7 * 24 * HOUR_MS
_NAMES, _CONDITIONS = list(HYPOTHESES), list(HYPOTHESES.values())
_U32 = 1 << 32


def shuffled_counts(rows: DataFrame, hypotheses: int, shuffles: int) -> DataFrame:
    """grp (a hypothesis), replicate and s0: how many of its hits have an UP outcome after each shuffle.

    rows: series, block, hour, up, flags array<boolean>. In a shuffle the cycles of a block are put in the order of a hash of
    cycle and shuffle, and the cycle at each place takes the outcome of the cycle that was there by time. All shuffles of a
    block are one matrix product of shuffled outcomes and hits; a task holds one block (a series' week) and the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, last = np.zeros((hypotheses, shuffles)), [], None
        step = np.arange(1, shuffles + 1, dtype=np.uint32) * np.uint32(_STEP)

        def block() -> np.ndarray:
            hour, up, hit = (np.concatenate([h[k] for h in held]) for k in range(3))
            by_time = np.argsort(hour, kind="stable")
            hour, up, hit = hour[by_time], up[by_time], hit[by_time]
            seed = seeds(np.full(len(hour), last[0]), hour)
            order = np.lexsort((np.broadcast_to(hour[:, None], (len(hour), shuffles)), mixed(seed[:, None] + step[None, :])), axis=0)
            moved = np.zeros((len(hour), shuffles))
            np.put_along_axis(moved, order, np.broadcast_to(up[:, None], moved.shape), axis=0)
            return hit.T @ moved

        for b in batches:
            key = np.stack([b.column("series").to_numpy(), b.column("block").to_numpy()], axis=1)
            hit = b.column("flags").flatten().to_numpy(zero_copy_only=False).reshape(-1, hypotheses).astype(np.float64)
            hour, up = b.column("hour").to_numpy(), b.column("up").to_numpy(zero_copy_only=False).astype(np.float64)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                now = (int(key[a, 0]), int(key[a, 1]))
                if held and now != last:
                    total += block()
                    held = []
                last = now
                held.append((hour[a:z], up[a:z], hit[a:z]))
        if held:
            total += block()
            yield from passed_on({k: total[k : k + 1] for k in range(hypotheses)}, shuffles)

    keys = ["series", "block"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys).select("series", "block", "hour", "up", "flags")
    return added(ordered.mapInArrow(run, passed_schema(1)), 1, shuffles)


def _mix_sql(x: str, shift: int, by: int) -> str:
    return f"(xor({x}, {x} >> {shift}) * {by}) % {_U32}"


def _seed_sql(table: str, ids: tuple[str, ...]) -> tuple[str, str]:
    """Common table expressions that give `table` a column seed, as `seeds` makes it, and the name of the last one."""
    out, name, before = "", table, "CAST(0 AS UBIGINT)"
    for k, x in enumerate(ids):
        out += f"{table}_{k}a AS (SELECT *, CAST(({before} + {x} % {_U32}) % {_U32} AS UBIGINT) AS h{k} FROM {name}), {table}_{k}b AS (SELECT * REPLACE ({_mix_sql(f'h{k}', 16, _M1)} AS h{k}) FROM {table}_{k}a), "
        out += f"{table}_{k}c AS (SELECT * REPLACE ({_mix_sql(f'h{k}', 15, _M2)} AS h{k}) FROM {table}_{k}b), {table}_{k}d AS (SELECT * REPLACE (xor(h{k}, h{k} >> 16) AS h{k}) FROM {table}_{k}c), "
        name, before = f"{table}_{k}d", f"h{k}"
    return out, name


_SEEDED, _LAST = _seed_sql("cyc", ("series", "hour"))
_Z = "(-greatest((abs(k - n * 0.5) - 0.5) / sqrt(n * 0.25), 0))"


@query(
    f"""WITH {FEATURES_SQL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY cycle_ts) AS i, lag(ret) OVER (PARTITION BY series ORDER BY cycle_ts) AS r1 FROM feats),
vr AS (SELECT 1 + corr(ret, r1) AS vr, sqrt(count(r1)) * corr(ret, r1) AS z FROM ordered WHERE r1 IS NOT NULL), cuts AS (SELECT quantile_cont(round(rng, 4), [0.333, 0.667]) AS cut_at FROM feats),
cyc AS (SELECT series, CAST(floor(cycle_ts / {BLOCK_MS}) AS BIGINT) AS block, cycle_ts // {HOUR_MS} AS hour, next_d > 0 AS up, c AS close, CASE WHEN round(rng, 4) <= cut_at[1] THEN 0 WHEN round(rng, 4) <= cut_at[2] THEN 1 ELSE 2 END AS tercile, cycle_ts >= {HALF} AS later, [{', '.join(f'coalesce({c}, false)' for c in _CONDITIONS)}] AS flags FROM feats, cuts),
hits AS (SELECT series, block, hour, up, close, tercile, later, h FROM (SELECT *, unnest(flags) AS hit, unnest(range({len(_NAMES)})) AS h FROM cyc) WHERE hit),
whole AS (SELECT h, count(*) AS n, count(*) FILTER (up) AS k, count(*) FILTER (later) AS n_later, count(*) FILTER (later AND up) AS k_later, avg(close) AS implied, {', '.join(f"count(*) FILTER (tercile = {t}) AS n{t}, count(*) FILTER (tercile = {t} AND up) AS k{t}" for t in range(3))} FROM hits GROUP BY 1),
weeks AS (SELECT h, count(*) AS weeks, count(*) FILTER (2 * k > n) AS good FROM (SELECT h, block, count(*) AS n, count(*) FILTER (up) AS k FROM hits GROUP BY 1, 2) GROUP BY 1),
blocks AS (SELECT series, block, count(*) AS m, count(*) FILTER (up) AS ups FROM cyc GROUP BY 1, 2), expected AS (SELECT h, sum(k * ups / m) AS e FROM (SELECT h, series, block, count(*) AS k FROM hits GROUP BY 1, 2, 3) JOIN blocks USING (series, block) GROUP BY 1),
{_SEEDED}s0 AS (SELECT series, block, hour, up, r, CAST((h1 + r * {_STEP}) % {_U32} AS UBIGINT) AS x FROM {_LAST}, (SELECT CAST(unnest(range(1, {SHUFFLES + 1})) AS UBIGINT) AS r)),
s1 AS (SELECT * REPLACE ({_mix_sql('x', 16, _M1)} AS x) FROM s0), s2 AS (SELECT * REPLACE ({_mix_sql('x', 15, _M2)} AS x) FROM s1), s3 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM s2),
placed AS (SELECT *, row_number() OVER (PARTITION BY series, block, r ORDER BY x, hour) AS place FROM s3), by_time AS (SELECT series, block, up AS moved, row_number() OVER (PARTITION BY series, block ORDER BY hour) AS place FROM cyc),
moved AS (SELECT p.series, p.hour, p.r, t.moved FROM placed p JOIN by_time t ON p.series = t.series AND p.block = t.block AND p.place = t.place), drawn AS (SELECT h, r, count(*) FILTER (moved) AS k FROM hits JOIN moved ON hits.series = moved.series AND hits.hour = moved.hour GROUP BY 1, 2),
perm AS (SELECT d.h, (1 + count(*) FILTER (abs(d.k - e) >= abs(w.k - e) - 1e-9)) / {SHUFFLES + 1}.0::DOUBLE AS p FROM drawn d JOIN whole w USING (h) JOIN expected USING (h) GROUP BY 1)
SELECT {[*_NAMES]}[h + 1] AS hypothesis, n, k, round(k / n, 6) AS rate, round(vr, 4) AS variance_ratio, round(z, 3) AS walk_z, round(implied, 6) AS implied, round((k / n - implied) * 100, 4) AS edge_pp, round(least(1.0, 2 * {stats.normal_cdf_sql(_Z)}), 7) AS binomial_p, n_later, k_later,
  weeks, good AS good_weeks, {', '.join(f"CASE WHEN n{t} > 0 THEN round(k{t} / n{t}, 6) END AS rate_t{t}" for t in range(3))}, round(expected.e, 6) AS expected, round(p, 6) AS permutation_p FROM whole JOIN weeks USING (h) JOIN expected USING (h) JOIN perm USING (h), vr"""
)
def backtest_layers(spark, d):
    """DP21, AG38: one row for each hypothesis on four layers: the variance ratio of two cycles and its score, what the close before
    implies and the edge over it, record with p and its later half, and robustness by week, tercile of range and a two-sided
    permutation test that shuffles outcomes inside a series' week."""
    rows = written(features(spark, d), "features")
    w = Window.partitionBy("series").orderBy("cycle_ts")
    pairs = rows.select("ret", F.lag("ret").over(w).alias("r1")).filter("r1 IS NOT NULL")
    corr = stats.correlation(F.col("ret"), F.col("r1"))
    walk = pairs.agg((1 + corr).alias("vr"), (F.sqrt(F.count("r1")) * corr).alias("z"))
    # a range in [0, 1) has 10,000 values at four digits, which bounds what the percentile holds
    cuts = stats.percentiles(rows, {"rng": F.round("rng", 4)}, {"cut_low": ("rng", 0.333), "cut_high": ("rng", 0.667)})
    flags = F.array(*(F.coalesce(F.expr(c), F.lit(False)) for c in _CONDITIONS))
    size = F.round("rng", 4)
    tercile = F.when(size <= F.col("cut_low"), 0).when(size <= F.col("cut_high"), 1).otherwise(2)
    cyc = rows.withColumns({"flags": flags}).join(F.broadcast(cuts))  # one row
    cyc = written(cyc.select("series", F.floor(F.col("cycle_ts") / BLOCK_MS).alias("block"), F.floor(F.col("cycle_ts") / HOUR_MS).alias("hour"), (F.col("next_d") > 0).alias("up"), F.col("c").alias("close"), tercile.alias("tercile"), (F.col("cycle_ts") >= HALF).alias("later"), "flags"), "cycles")
    hit = F.filter(F.transform("flags", lambda x, i: F.when(x, i)), lambda x: x.isNotNull())
    per = cyc.select("series", "block", "up", "close", "tercile", "later", F.explode(hit).alias("h")).groupBy("h", "series", "block").agg(
        F.count("*").alias("n"), F.count_if("up").alias("k"), F.count_if("later").alias("n_later"), F.count_if(F.col("later") & F.col("up")).alias("k_later"), F.sum("close").alias("close"),
        *(F.count_if(F.col("tercile") == t).alias(f"n{t}") for t in range(3)), *(F.count_if((F.col("tercile") == t) & F.col("up")).alias(f"k{t}") for t in range(3)),
    )
    blocks = cyc.groupBy("series", "block").agg(F.count("*").alias("m"), F.count_if("up").alias("ups"))
    per = written(per.join(blocks, ["series", "block"]), "blocks")
    sums = ["n", "k", "n_later", "k_later", "close", "n0", "n1", "n2", "k0", "k1", "k2"]
    whole = per.groupBy("h").agg(*(F.sum(c).alias(c) for c in sums), F.sum(F.col("n") * F.col("ups") / F.col("m")).alias("e"))
    weeks = per.groupBy("h", "block").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).groupBy("h").agg(F.count("*").alias("weeks"), F.count_if(2 * F.col("k") > F.col("n")).alias("good_weeks"))
    drawn = shuffled_counts(cyc, len(_NAMES), SHUFFLES).select(F.col("grp").cast("int").alias("h"), F.col("s0").alias("drawn"))
    far = F.count_if(F.abs(F.col("drawn") - F.col("e")) >= F.abs(F.col("k") - F.col("e")) - 1e-9)
    perm = drawn.join(whole.select("h", "k", "e"), "h").groupBy("h").agg(((1 + far) / (SHUFFLES + 1)).alias("p"))
    x = whole.join(weeks, "h").join(perm, "h").join(F.broadcast(walk))  # one row
    rate, implied = F.col("k") / F.col("n"), F.col("close") / F.col("n")
    return x.select(
        F.get(F.array(*map(F.lit, _NAMES)), "h").alias("hypothesis"), "n", "k", r6(rate).alias("rate"), F.round("vr", 4).alias("variance_ratio"), F.round("z", 3).alias("walk_z"), r6(implied).alias("implied"), F.round((rate - implied) * 100, 4).alias("edge_pp"),
        F.round(stats.normal_p(F.col("k"), F.col("n"), F.lit(0.5)), 7).alias("binomial_p"), "n_later", "k_later", "weeks", "good_weeks", *(r6(F.when(F.col(f"n{t}") > 0, F.col(f"k{t}") / F.col(f"n{t}"))).alias(f"rate_t{t}") for t in range(3)),
        r6("e").alias("expected"), r6("p").alias("permutation_p"),
    )
