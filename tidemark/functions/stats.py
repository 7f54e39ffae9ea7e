"""Statistics as column expressions; pandas UDFs only where Spark lacks the function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


# The lifts of the two tracks.
STRONG, WEAK = 1.4, 1.15


def _wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    centre = p + z2 / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    whole = 1 + z2 / n
    return (centre - half) / whole, (centre + half) / whole


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound with k held in [0, n]; 0 without observations."""
    n = n.cast("double")
    k = F.least(F.greatest(k.cast("double"), F.lit(0.0)), n)
    return F.when(n > 0, F.greatest(_wilson(k, n, z)[0], F.lit(0.0))).otherwise(0.0)


def wilson_bounds(k: Column, n: Column, z: float, empty: tuple, clamp: bool = True) -> Column:
    """Struct (lo, hi). empty: the two bounds without observations, which differ between uses."""
    n, k = n.cast("double"), k.cast("double")
    lo, hi = _wilson(k, n, z)
    if clamp:
        lo, hi = F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))
    none = [F.lit(x).cast("double") for x in empty]
    return F.struct(F.when(n > 0, lo).otherwise(none[0]).alias("lo"), F.when(n > 0, hi).otherwise(none[1]).alias("hi"))


def quantiles(ordered: Column, shares: tuple) -> Column:
    """Percentiles of an ascending array: both neighbours weighted, in one rounding of the sum, as quantile_cont has it.

    F.percentile rounds three times, so that it can miss by a bit the value of a row, which a threshold then cuts otherwise.
    """

    def at(p: float) -> Column:
        place = (F.size(ordered) - 1) * F.lit(float(p))
        return _between(place, F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int")))

    return F.array(*map(at, shares))


def _between(place: Column, low: Column, high: Column) -> Column:
    """The value at a place between two rows, in one rounding of the sum: also between equal rows, where it can miss them by a bit."""
    rest = place - F.floor(place)
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - rest, high * rest).cast("double")
    return F.when(low.isNotNull(), fused)


def percentiles(rows: DataFrame, values: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with percentiles over all rows, as `quantiles` has them: name -> (one of the values, share).

    Rows are counted by value, so the values should be read to a fixed number of digits.
    """
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(k).alias("of"), v.cast("double").alias("x")) for k, v in values.items()))))
    counts = each.filter("x IS NOT NULL").groupBy("of", "x").agg(F.count("*").alias("k"))
    held = counts.agg(*(F.array_sort(F.collect_list(F.when(F.col("of") == k, F.struct("x", "k")))).alias(k) for k in values))

    def at(of: str, i: Column) -> Column:
        """The value of row i in ascending order."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("x"))
        step = lambda a, c: F.struct((a["seen"] + c["k"]).alias("seen"), F.when(a["x"].isNull() & (a["seen"] + c["k"] > i), c["x"]).otherwise(a["x"]).alias("x"))
        return F.aggregate(of, start, step, lambda a: a["x"])

    sizes = held.select("*", *(F.aggregate(k, F.lit(0).cast("long"), lambda a, c: a + c["k"]).alias(f"n_{k}") for k in values))
    places = sizes.select("*", *(((F.col(f"n_{of}") - 1) * F.lit(float(p))).alias(f"at_{name}") for name, (of, p) in wanted.items()))
    ends = places.select("*", *(at(of, f(f"at_{name}")).alias(f"{end}_{name}") for name, (of, _) in wanted.items() for end, f in (("low", F.floor), ("high", F.ceil))))
    return ends.select(*(_between(F.col(f"at_{name}"), F.col(f"low_{name}"), F.col(f"high_{name}")).alias(name) for name in wanted))


def sum_in_order(value: Column | str, place: Column | str) -> Column:
    """Sum of doubles one after another by place. Partial sums in any order can miss it by a bit, which a threshold then cuts otherwise."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(place) if isinstance(place, str) else place, value.alias("x")))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["x"]))


def correlation(x: Column, y: Column, over: Callable[[Column], Column] = lambda agg: agg) -> Column:
    """Correlation of pairs, NaN where one side does not vary, for which F.corr divides by zero. over: turns an aggregate into that of a window."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(over(F.var_pop(F.when(both, x))) * over(F.var_pop(F.when(both, y))))
    return F.when(spread > 0, over(F.covar_pop(x, y)) / spread).when(spread == 0, float("nan"))


def minimum_effect(n: Column, z_alpha: float = 1.96, z_power: float = 0.8416) -> Column:
    """Smallest deviation from 1/2 that n observations can show."""
    return F.when(n > 0, (z_alpha + z_power) * 0.5 / F.sqrt(n.cast("double")))


def lift(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Struct (lift, log_se, lo, hi) of a/n over b/m by the delta method; lift 0 where degenerate."""
    a, n, b, m = (x.cast("double") for x in (a, n, b, m))
    ok = (a > 0) & (n > 0) & (b > 0) & (m > 0)
    value = (a / n) / (b / m)
    se = F.sqrt(F.greatest(1 / a - 1 / n + 1 / b - 1 / m, F.lit(1e-12)))
    zero = F.lit(0.0)
    return F.struct(
        F.when(ok, value).otherwise(zero).alias("lift"),
        F.when(ok, se).otherwise(zero).alias("log_se"),
        F.when(ok, F.exp(F.ln(value) - 1.96 * se)).otherwise(zero).alias("lo"),
        F.when(ok, F.exp(F.ln(value) + 1.96 * se)).otherwise(zero).alias("hi"),
    )


def verdict(lift_value: Column, lo: Column) -> Column:
    """Two tracks: strong lift with an interval over 1, weak lift to be watched, else rejected."""
    strong, weak = lift_value >= STRONG, lift_value >= WEAK
    return F.when(strong & (lo > 1), "ACTIVE").when(strong, "REJECT").when(weak, "OBSERVE").otherwise("REJECT")


# Numerator and denominator of the rational form of the normal law's tail, highest power first.
_TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_LOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf_sql(x: str) -> str:
    """The same as normal_cdf, as SQL text."""
    horner = lambda cs: "".join("(" for _ in cs[2:]) + f"{cs[0]} * z + {cs[1]}" + "".join(f") * z + {c}" for c in cs[2:])
    near = f"exp(-z * z / 2) * ({horner(_TAIL_TOP)}) / ({horner(_TAIL_LOW)})".replace("z", f"abs({x})")
    far = "exp(-z * z / 2) / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631".replace("z", f"abs({x})")
    tail = f"(CASE WHEN abs({x}) > 37 THEN 0.0 WHEN abs({x}) < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_cdf(x: Column) -> Column:
    """ST9: the normal law's distribution function to about 1e-14: a rational form, a continued fraction far out."""

    def horner(cs: tuple, z: Column) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * z + c
        return out

    def tail(z: Column) -> Column:
        bell = F.exp(-z * z / 2)
        far = z + 0.65
        for k in (4, 3, 2, 1):
            far = z + k / far
        return F.when(z > 37, 0.0).when(z < 7.07106781186547, bell * horner(_TAIL_TOP, z) / horner(_TAIL_LOW, z)).otherwise(bell / far / 2.506628274631)

    # transform over one element names |x|, which the forms would compute anew for each use
    t = F.get(F.transform(F.array(F.abs(x)), tail), F.lit(0))
    return F.when(x > 0, 1 - t).otherwise(t)


def normal_p(k: Column, n: Column, p0: Column) -> Column:
    """ST8: two-sided p by the normal law, with continuity correction."""
    z = (F.abs(k - n * p0) - 0.5) / F.sqrt(n * p0 * (1 - p0))
    return F.least(F.lit(1.0), 2 * normal_cdf(-F.greatest(z, F.lit(0.0))))


def _masses(n: int, p0: float, k: int) -> tuple[np.ndarray, int]:
    """Probabilities of the counts within 12 deviations of the mean, and the count of the first.

    From the ratio of each two neighbours, so no term is as large as n; what lies outside is under 1e-30.
    """
    middle, reach = n * p0, 12 * math.sqrt(n * p0 * (1 - p0)) + 20
    lo, hi = max(0, int(middle - reach)), min(n, int(middle + reach))
    i = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p0 / (1 - p0)))))
    mass = np.exp(logs - logs.max())
    return mass / mass.sum(), lo


def exact_two_sided(k, n, p0) -> float:
    if pd.isna(k) or pd.isna(n) or n <= 0:
        return 1.0
    mass, lo = _masses(int(n), float(p0), int(k))
    at = int(k) - lo
    return float(min(1.0, mass[mass <= mass[at] * (1 + 1e-9)].sum())) if 0 <= at < len(mass) else 0.0


def exact_lower(k, n, p0) -> float:
    if pd.isna(k) or pd.isna(n) or n <= 0:
        return 1.0
    mass, lo = _masses(int(n), float(p0), int(k))
    return float(min(1.0, mass[: max(0, int(k) - lo + 1)].sum()))


@pandas_udf(DoubleType())
def binomial_p(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ST6: exact two-sided p at every n: the probability of all counts no likelier than k (0 below 1e-30)."""
    for k, n, p0 in batches:
        yield pd.Series([exact_two_sided(*row) for row in zip(k, n, p0, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def binomial_lower(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ST7: exact probability of at most k."""
    for k, n, p0 in batches:
        yield pd.Series([exact_lower(*row) for row in zip(k, n, p0, strict=True)], dtype="float64")
