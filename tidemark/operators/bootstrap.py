"""The bootstrap as an aggregate: every replicate weights every unit by a hashed Poisson(1) count.

A resample of n units draws each about Poisson(1) times, so a replicate's sum is the sum of weight * value
over all units, whatever task they are in. The weight is the inverse of the distribution at a hash of unit and
replicate: it needs no state, no order and no collected group, and is the same in any plan and in SQL.
A task adds up its units as matrix products; partial vectors are cut in blocks of replicates, dealt by group
and block, and added as they stream by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units whose weights are held at once, groups that a task holds, and replicates of a block.
UNITS, HELD, BLOCK = 512, 1024, 250
# Multipliers of the 32-bit mix, and the step between replicates.
_M1, _M2, _STEP = 0x7FEB352D, 0x846CA68B, 0x9E3779B9
_U32 = 1 << 32


def poisson_steps() -> list[int]:
    """The values of a 32-bit hash from which a Poisson(1) count is at least 1, 2, ..."""
    out, share, k = [], math.exp(-1), 0
    total = share
    while int(total * _U32) < _U32 - 1:
        out.append(int(total * _U32))
        k += 1
        share /= k
        total += share
    return out


STEPS = poisson_steps()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(_M1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(_M2)
    return x ^ (x >> np.uint32(16))


def seeds(*ids: np.ndarray) -> np.ndarray:
    """A 32-bit seed of each unit from its whole-number ids."""
    out = np.zeros(len(ids[0]), np.uint32)
    for x in ids:
        out = mixed(out + (x.astype(np.int64) % _U32).astype(np.uint32))
    return out


def weights(seed: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) counts, one row a unit and one column a replicate."""
    h = mixed(seed[:, None] + np.arange(1, replicates + 1, dtype=np.uint32)[None, :] * np.uint32(_STEP))
    return np.searchsorted(np.array(STEPS, np.uint32), h, side="right").astype(np.float64)


def _bounds(replicates: int) -> list[tuple[int, int]]:
    return [(b, min(replicates, b + BLOCK)) for b in range(0, replicates, BLOCK)]


def passed_schema(values: int) -> str:
    return "grp long, block int, " + ", ".join(f"s{k} binary" for k in range(values))


def passed_on(held: dict[int, np.ndarray], replicates: int) -> Iterator[pa.RecordBatch]:
    """A task's sums, group -> (values, replicates), in blocks of replicates."""
    bounds = _bounds(replicates)
    keys = [(g, k) for g in held for k in range(len(bounds))]
    n = len(next(iter(held.values())))
    sums = [[held[g][v, bounds[k][0] : bounds[k][1]].astype("<f8").tobytes() for g, k in keys] for v in range(n)]
    columns = [pa.array([g for g, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int32()), *(pa.array(s, pa.binary()) for s in sums)]
    yield pa.RecordBatch.from_arrays(columns, names=["grp", "block", *(f"s{v}" for v in range(n))])


def added(partial: DataFrame, values: int, replicates: int) -> DataFrame:
    """grp, replicate and the sums of all tasks' blocks, which are dealt by group and block and added as they come."""
    bounds, names = _bounds(replicates), [f"s{k}" for k in range(values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for g, k, *sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = np.stack([np.frombuffer(s, "<f8") for s in sums])
                total[g, k] = total[g, k] + new if (g, k) in total else new
        for (g, k), sums in total.items():
            first, end = bounds[k]
            cols = [pa.array(np.full(end - first, g)), pa.array(np.arange(first + 1, end + 1), pa.int32()), *(pa.array(s) for s in sums)]
            yield pa.RecordBatch.from_arrays(cols, names=["grp", "replicate", *names])

    return partial.repartition("grp", "block").mapInArrow(run, "grp long, replicate int, " + ", ".join(f"{n} double" for n in names))


def replicate_sums(rows: DataFrame, group: str, ids: list[str], values: list[str], replicates: int = 2000) -> DataFrame:
    """group, replicate and the weighted sum of each value: a row of `rows` is what a unit (`ids`) gives to a group (a long).

    Units may give to several groups, with one weight. A task holds HELD groups of replicates * values numbers
    at most, then it passes them on; the adding tasks hold those of their keys.
    """
    names = [f"s{k}" for k in range(len(values))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            seed = seeds(*(b.column(c).to_numpy() for c in ids))
            group_of, data = b.column("grp").to_numpy(), [b.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
            units, unit_of = np.unique(seed, return_inverse=True)
            order = np.argsort(unit_of, kind="stable")
            bounds = np.searchsorted(unit_of[order], np.arange(0, len(units) + UNITS, UNITS))
            for first, a, z in zip(range(0, len(units), UNITS), bounds[:-1], bounds[1:], strict=False):
                at = order[a:z]
                w = weights(units[first : first + UNITS], replicates)
                groups, place = np.unique(group_of[at], return_inverse=True)
                for lo in range(0, len(groups), HELD):
                    mine = (place >= lo) & (place < lo + HELD)
                    shape = (min(HELD, len(groups) - lo), len(w))
                    cell = (place[mine] - lo) * shape[1] + unit_of[at][mine] - first
                    products = [np.bincount(cell, v[at][mine], shape[0] * shape[1]).reshape(shape) @ w for v in data]
                    for k, g in enumerate(groups[lo : lo + HELD].tolist()):
                        got = np.stack([p[k] for p in products])
                        held[g] = held[g] + got if g in held else got
                if len(held) > HELD:
                    yield from passed_on(held, replicates)
                    held = {}
        if held:
            yield from passed_on(held, replicates)

    flat = rows.select(F.col(group).cast("long").alias("grp"), *(F.col(c).cast("long").alias(c) for c in ids), *(F.col(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)))
    summed = added(flat.mapInArrow(partial, passed_schema(len(values))), len(values), replicates)
    return summed.select(F.col("grp").alias(group), "replicate", *(F.col(n).alias(v) for n, v in zip(names, values, strict=True)))


def ratio_intervals(rows: DataFrame, group: str, ids: list[str], value: str, size: str, replicates: int = 2000, ends: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """group, lo and hi: percentiles over the replicates of sum(value) / sum(size); a replicate without units is left out."""
    sums = replicate_sums(rows, group, ids, [value, size], replicates)
    cuts = sums.groupBy(group).agg(F.percentile(F.col(value) / F.nullif(F.col(size), F.lit(0.0)), list(ends)).alias("cuts"))
    return cuts.select(group, F.get("cuts", F.lit(0)).alias("lo"), F.get("cuts", F.lit(1)).alias("hi"))


def intervals_within(rows: DataFrame, whole: str, group: str, ids: list[str], value: str, size: str, replicates: int = 2000, ends: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """ratio_intervals for groups of which each lies in one value of `whole`, as many and as small as series: only the rows are
    shuffled, by `whole`, and a task holds its groups' replicates until it has their ends."""

    def cuts(t: pa.Table) -> pa.Table:
        units, unit_of = np.unique(seeds(*(t.column(c).to_numpy() for c in ids)), return_inverse=True)
        groups, place = np.unique(t.column("grp").to_numpy(), return_inverse=True)
        order = np.argsort(unit_of, kind="stable")
        bounds = np.searchsorted(unit_of[order], np.arange(0, len(units) + UNITS, UNITS))
        data, total = [t.column(c).to_numpy() for c in ("s0", "s1")], np.zeros((2, len(groups), replicates))
        for first, a, z in zip(range(0, len(units), UNITS), bounds[:-1], bounds[1:], strict=False):
            at, w = order[a:z], weights(units[first : first + UNITS], replicates)
            cell = place[at] * len(w) + unit_of[at] - first
            for k, v in enumerate(data):
                total[k] += np.bincount(cell, v[at], len(groups) * len(w)).reshape(-1, len(w)) @ w
        got = [np.percentile(top[size != 0] / size[size != 0], [100 * p for p in ends]) if size.any() else (None, None) for top, size in zip(*total, strict=True)]
        return pa.table({"grp": pa.array(groups, pa.int64()), "lo": pa.array([x[0] for x in got], pa.float64()), "hi": pa.array([x[1] for x in got], pa.float64())})

    flat = rows.select(F.col(whole).alias("whole"), F.col(group).cast("long").alias("grp"), *(F.col(c).cast("long").alias(c) for c in ids), F.col(value).cast("double").alias("s0"), F.col(size).cast("double").alias("s1"))
    return flat.groupBy("whole").applyInArrow(cuts, "grp long, lo double, hi double").withColumnRenamed("grp", group)


def draws_sql(rows: str, ids: list[str], replicates: int = 2000) -> str:
    """Common table expressions up to `drawn` (ids, replicate r, weight w) of the units of the table `rows` for DuckDB."""
    h = f"(seed + r * {_STEP}) % {_U32}"
    weight = " + ".join(f"CAST(h >= {s} AS INTEGER)" for s in STEPS)
    keys = ", ".join(ids)
    mix = lambda x, shift, m: f"(xor({x}, {x} >> {shift}) * {m}) % {_U32}"
    chain, before = "", "CAST(0 AS UBIGINT)"
    for k, x in enumerate(ids):
        chain += f"seed{k}a AS (SELECT *, CAST(({before} + {x} % {_U32}) % {_U32} AS UBIGINT) AS z{k} FROM {f'seed{k - 1}d' if k else f'(SELECT DISTINCT {keys} FROM {rows})'}), "
        chain += f"seed{k}b AS (SELECT *, {mix(f'z{k}', 16, _M1)} AS y{k} FROM seed{k}a), seed{k}c AS (SELECT *, {mix(f'y{k}', 15, _M2)} AS x{k} FROM seed{k}b), seed{k}d AS (SELECT *, xor(x{k}, x{k} >> 16) AS w{k} FROM seed{k}c), "
        before = f"w{k}"
    return f"""{chain}seeded AS (SELECT {keys}, {before} AS seed FROM seed{len(ids) - 1}d), hash0 AS (SELECT {keys}, r, CAST({h} AS UBIGINT) AS h FROM seeded, (SELECT CAST(unnest(range(1, {replicates + 1})) AS UBIGINT) AS r)),
hash1 AS (SELECT {keys}, r, {mix('h', 16, _M1)} AS h FROM hash0), hash2 AS (SELECT {keys}, r, {mix('h', 15, _M2)} AS h FROM hash1), hash3 AS (SELECT {keys}, r, xor(h, h >> 16) AS h FROM hash2),
drawn AS (SELECT {keys}, CAST(r AS INTEGER) AS r, {weight} AS w FROM hash3)"""


def intervals_sql(rows: str, group: str, ids: list[str], value: str, size: str, replicates: int = 2000) -> str:
    """The same with `cuts` (group, lo, hi), as ratio_intervals gives them."""
    return f"""{draws_sql(rows, ids, replicates)},
means AS (SELECT {group}, r, sum(w * {value}) / nullif(sum(w * {size}), 0) AS mean FROM {rows} JOIN drawn USING ({', '.join(ids)}) GROUP BY 1, 2),
cuts AS (SELECT {group}, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM means GROUP BY 1)"""
