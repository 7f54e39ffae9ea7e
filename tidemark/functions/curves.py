"""Kernels over a curve's values (ARRAY<DOUBLE>) as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five symbols of a change, in the order of the bins.
SYMBOLS = ("drop", "dip", "flat", "rise", "surge")


def deltas(v: Column) -> Column:
    """AF2: adjacent differences; empty for fewer than two values."""
    n = F.size(v)
    return F.when(n >= 2, F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)).otherwise(F.array().cast("array<double>"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def extrema(v: Column) -> Column:
    """AF7: places (from 0) of strict local extrema."""
    n = F.size(v)
    inner = F.when(n >= 3, F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(v, i)
    return F.filter(inner, lambda i: ((at(i) > at(i - 1)) & (at(i) > at(i + 1))) | ((at(i) < at(i - 1)) & (at(i) < at(i + 1))))


def curliness(v: Column) -> Column:
    """AF9: total variation over the net move."""
    d = deltas(v)
    way, net = total(F.transform(d, F.abs)), F.abs(total(d))
    return F.when(F.size(v) < 2, 1.0).when(net > 1e-12, way / net).when(way == 0, 1.0).otherwise(F.least(way, F.lit(99.0)))


def area_ratio(v: Column) -> Column:
    """AF8: share of the deviation from the first-last chord that lies above it; one half if there is none."""
    n = F.size(v)
    step = (F.get(v, n - 1) - F.get(v, F.lit(0))) / F.greatest(n - 1, F.lit(1))
    off = F.transform(v, lambda x, i: x - (F.get(v, F.lit(0)) + step * i))
    up, whole = total(F.transform(off, lambda x: F.greatest(x, F.lit(0.0)))), total(F.transform(off, F.abs))
    return F.when((n >= 2) & (whole > 0), up / whole).otherwise(0.5)


def run_up(v: Column) -> Column:
    """WF16: the largest rise from a running minimum."""
    start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        low = F.least(F.coalesce(a["low"], x), x)
        return F.struct(low.alias("low"), F.greatest(a["best"], x - low).alias("best"))

    return F.aggregate(v, start, step, lambda a: a["best"])


def drawdown(v: Column) -> Column:
    """WF16: the largest fall from a running maximum."""
    return run_up(F.transform(v, lambda x: -x))


def slope(v: Column) -> Column:
    """AF18: least squares over x = i / (n - 1)."""
    n = F.size(v)
    mean = total(v) / n
    x = lambda i: i / (n - 1) - 0.5
    top = total(F.transform(v, lambda y, i: x(i) * (y - mean)))
    return F.when(n >= 2, top / total(F.transform(v, lambda y, i: x(i) * x(i)))).otherwise(0.0)


def symbol(delta: Column, edges: Column) -> Column:
    """AF6: one of SYMBOLS by left-closed bins."""
    s = F.when(delta < F.get(edges, F.lit(0)), SYMBOLS[0])
    for k in (1, 2, 3):
        s = s.when(delta < F.get(edges, F.lit(k)), SYMBOLS[k])
    return s.otherwise(SYMBOLS[4])


def direction(symbols: Column) -> Column:
    return F.transform(symbols, lambda s: F.when(s.isin("surge", "rise"), "U").when(s.isin("dip", "drop"), "D").otherwise("F"))


def has_run(symbols: Column, wanted: list[str]) -> Column:
    """AF13: whether wanted occurs as a contiguous run."""
    n, m = F.size(symbols), len(wanted)
    look = F.array(*map(F.lit, wanted))
    return (n >= m) & F.exists(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.slice(symbols, i, m) == look)


def first_hit(curve: Column, since: Column, t_lo: int, t_hi: int, q_lo: float, q_hi: float) -> Column:
    """AF40: the first point with t - since in [t_lo, t_hi) ms and v in [q_lo, q_hi)."""
    inside = F.filter(curve, lambda p: (p["t"] - since >= t_lo) & (p["t"] - since < t_hi) & (p["v"] >= q_lo) & (p["v"] < q_hi))
    return F.get(inside, F.lit(0))
