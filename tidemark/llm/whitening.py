"""Embedding whitening: an exact integer scatter, floats only for the eigenvectors.

Every entry c becomes the whole number x = floor(scale * c) + shift. One pass subtracts the shift,
y = x - shift, and adds up n, S = sum(y) and XtX = sum(y yT) as whole numbers of any size: a batch is
split in limbs of 20 bits whose products and sums stay below 2^53, where the matrix product of doubles
is exact; a task adds its batches as Python integers; Spark adds up the tasks by cell in signed digits
of 30 bits, so no sum overflows. n * XtX - S ST is then n^2 times the covariance, without an error,
and only now becomes doubles for `eigh`. What is small beside the largest variance is projected in whole
numbers and decomposed again, and the variance along each vector found is computed from the whole numbers,
so that small components keep their digits.

A vector that is null or holds null or non-finite entries is dropped. Shorter vectors count as padded
with entries of 0, an empty one too; more than MOST_DIMS dimensions are an error. floor(scale * c) beyond
+-2^62 counts as that end. Null and repeated ids and repeated rows are rows as others are. Directions
without variance (all below TINY of the largest) can't be whitened and are no components, so one vector
alone, or copies of one, give no rows; nor does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Rows of a product, bits of a limb (2 * LIMB + log2(ROWS) <= 53), bits of a digit, and dimensions.
ROWS, LIMB, DIGIT, MOST_DIMS = 8192, 20, 30, 2048
#: Share of the largest variance below which a direction has none, and below which it is decomposed anew.
TINY, STEP = 1e-22, 1e-6
_END = float(1 << 62)


def shifted(column: pa.Array, scale: float, dim: int | None = None) -> np.ndarray:
    """y = floor(scale * c) of usable vectors, one row each, padded with zeros to dim (or the longest)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    dim = int(lengths.max(initial=0)) if dim is None else dim
    with np.errstate(over="ignore"):
        y = np.clip(np.floor(scale * flat), -_END, _END).astype(np.int64)
    if (lengths == dim).all():
        return y.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = y
    return out


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limbs[k] * 2^(LIMB * k), each a double below 2^LIMB, with the sign of y."""
    sign, rest, out = np.sign(y), np.abs(y), []
    while True:
        out.append((sign * (rest & ((1 << LIMB) - 1))).astype(np.float64))
        rest = rest >> LIMB
        if not rest.any():
            return out


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sum(y) and sum(y yT) over rows as Python integers."""
    dim = y.shape[1]
    first, second = np.zeros(dim, object), np.zeros((dim, dim), object)
    for at in range(0, len(y), ROWS):
        limbs = _limbs(y[at : at + ROWS])
        for a, left in enumerate(limbs):
            first = first + (left.sum(axis=0).astype(np.int64).astype(object) << (LIMB * a))
            for b, right in enumerate(limbs):
                second = second + ((left.T @ right).astype(np.int64).astype(object) << (LIMB * (a + b)))
    return first, second


def _wider(x: np.ndarray, dim: int) -> np.ndarray:
    """x with zeros up to dim in each direction."""
    out = np.zeros((dim,) * x.ndim, object)
    out[tuple(slice(k) for k in x.shape)] = x
    return out


def _digits(value: int) -> list[int]:
    """Signed digits of value by DIGIT bits, lowest first."""
    sign, rest, out = (-1, -value, []) if value < 0 else (1, value, [])
    while rest:
        out.append(sign * (rest & ((1 << DIGIT) - 1)))
        rest >>= DIGIT
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of all vectors without null or non-finite entries."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


@dataclass
class Scatter:
    """n, S and sum(y yT) of y = x - shift, all exact."""

    n: int
    total: np.ndarray
    products: np.ndarray

    def deviation(self) -> np.ndarray:
        """n * XtX - S ST, n^2 times the covariance."""
        return self.n * self.products - np.outer(self.total, self.total)


def scatter(rows: DataFrame, scale: float) -> Scatter:
    """Exact sums over all rows. A cell (i, j) with i <= j is an entry of sum(y yT), (i, -1) one of S, (-1, -1) is n.

    A task gives dims^2 / 2 cells whatever it reads; the driver gets as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for b in batches:
            if not b.num_rows:
                continue
            y = shifted(b.column("v"), scale)
            if y.shape[1] > MOST_DIMS:
                raise ValueError(f"{y.shape[1]} dimensions, more than {MOST_DIMS}")
            s, p = exact_sums(y)
            dim = max(len(s), len(first))
            n, first, second = n + len(y), _wider(first, dim) + _wider(s, dim), _wider(second, dim) + _wider(p, dim)
        cells = [((-1, -1), n), *(((i, -1), int(x)) for i, x in enumerate(first))]
        for i in range(len(first)):
            cells += [((i, j), int(x)) for j, x in enumerate(second[i, i:], i)]
            out = [(*cell, k, d) for cell, x in cells for k, d in enumerate(_digits(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "place", "digit"])
            cells = []
        if cells and n:  # vectors without a dimension
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64())], names=["i", "j", "place", "digit"])

    added = rows.select("v").mapInArrow(run, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    whole: dict[tuple[int, int], int] = {}
    for i, j, place, digit in added.toLocalIterator():
        whole[i, j] = whole.get((i, j), 0) + (digit << (DIGIT * place))
    # an entry that is 0 everywhere gives no cell, but its dimension still counts: it adds nothing
    dim = 1 + max((max(c) for c in whole), default=-1)
    total, products = np.zeros(dim, object), np.zeros((dim, dim), object)
    for (i, j), x in whole.items():
        if i >= 0 and j < 0:
            total[i] = x
        elif i >= 0:
            products[i, j] = products[j, i] = x
    return Scatter(whole.get((-1, -1), 0), total, products)


@dataclass
class Whitener:
    """Components by falling variance: unit vectors (columns), variances, and their shares of the whole."""

    scatter: Scatter
    scale: float
    vectors: np.ndarray
    variance: np.ndarray
    share: np.ndarray

    def away(self, column: pa.Array) -> np.ndarray:
        """n * x - S of vectors, exact: longs, or Python integers where their squares could leave the long range."""
        s = self.scatter
        y = shifted(column, self.scale)
        dim = len(s.total)
        y = y[:, :dim] if y.shape[1] >= dim else np.pad(y, ((0, 0), (0, dim - y.shape[1])))
        most = s.n * int(np.abs(y).max(initial=0)) + max((abs(int(x)) for x in s.total), default=0)
        if most**2 * max(1, dim) < 1 << 63:
            return s.n * y - s.total.astype(np.int64)
        return s.n * y.astype(object) - s.total

    def apply(self, away: np.ndarray) -> np.ndarray:
        return (away.astype(np.float64) / self.scatter.n) @ self.vectors / np.sqrt(self.variance)


def _floats(whole: np.ndarray) -> np.ndarray:
    """Python integers as doubles, all scaled down by one power of 2 where they are out of range."""
    low = max(0, max((int(x).bit_length() for x in whole.ravel()), default=0) - 1000)
    return np.array([[float(int(x) >> low) for x in row] for row in whole], np.float64).reshape(whole.shape)


def directions(exact: np.ndarray, most: int) -> np.ndarray:
    """Unit eigenvectors (columns) of a matrix of Python integers by falling eigenvalue, `most` of them.

    `eigh` knows small eigenvalues only to the rounding of the largest, so where some are below STEP of it,
    the matrix is projected on the rest, in whole numbers, and decomposed again.
    """
    dim = len(exact)
    basis, projected, found = np.eye(dim), exact, []
    while basis.shape[1] and sum(f.shape[1] for f in found) < most:
        e, v = np.linalg.eigh(_floats(projected))
        e, v = e[::-1], v[:, ::-1]
        known = e > STEP * e[0]
        if e[0] <= 0:
            break
        found.append(basis @ v[:, known])
        basis = basis @ v[:, ~known]
        grid = np.rint(basis * 2.0**52).astype(np.int64).astype(object)
        projected = grid.T @ exact @ grid if grid.size else exact[:0, :0]
    return np.concatenate([np.zeros((dim, 0)), *found], axis=1)[:, :most]


def fit(rows: DataFrame, scale: float = 64.0, most: int = 32) -> Whitener:
    """The whitener of usable rows; only dims^2 numbers reach the driver."""
    s = scatter(rows, scale)
    exact = s.deviation()
    trace = sum((int(exact[i, i]) for i in range(len(exact))), 0)
    if not trace:
        return Whitener(s, scale, np.zeros((len(s.total), 0)), np.zeros(0), np.zeros(0))
    unit = Fraction(s.n * s.n)
    v = directions(exact, most)
    # the variance along each vector, from whole numbers: vectors on a grid of 2^-52
    grid = np.rint(v * 2.0**52).astype(np.int64).astype(object)
    along = exact @ grid
    variance = np.array([float(Fraction(int(sum(grid[:, k] * along[:, k])), int(sum(grid[:, k] * grid[:, k]))) / unit) for k in range(v.shape[1])])
    again = np.argsort(-variance, kind="stable")
    v, variance = v[:, again], variance[again]
    keep = variance > TINY * variance[0]
    return Whitener(s, scale, v[:, keep], variance[keep], variance[keep] / float(Fraction(trace) / unit))


def identity_error(rows: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows.

    A task centres its rows and merges batches; the tasks' sums are added up by Spark about a common middle.
    """
    k = len(whitener.variance)
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(whitener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if not b.num_rows:
                continue
            w = shared.value.apply(shared.value.away(b.column("v")))
            m = w.mean(axis=0)
            off, c = m - mean, w - m
            both = n + len(w)
            spread += c.T @ c + np.outer(off, off) * (n * len(w) / both)
            mean, n = mean + off * (len(w) / both), both
        if n:
            # sum of (w - a)(w - a)T about the common middle a = 0, and sum of w
            values = np.concatenate(([n], n * mean, (spread + n * np.outer(mean, mean)).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["cell", "value"])

    got = np.zeros(1 + k + k * k)
    for cell, value in rows.select("v").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        got[cell] = value
    n, mean = got[0], got[1 : 1 + k] / got[0]
    return float(np.abs(got[1 + k :].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, scale: float = 64.0, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, and deviation_exact with all digits (deviation is null where a long can't hold it)."""
    rows = usable(vectors, id_col, vec_col)
    whitener = fit(rows, scale, most)
    error = identity_error(rows, whitener)
    shared = rows.sparkSession.sparkContext.broadcast(whitener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            away = shared.value.away(b.column("v"))
            w = shared.value.apply(away)
            total = [int(x) for x in (away * away).sum(axis=1)]
            fits = pa.array([x if x < 1 << 63 else None for x in total], pa.int64())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), fits, pa.array([str(x) for x in total], pa.string()), values], names=["vec_id", "deviation", "deviation_exact", "w"])

    got = rows.mapInArrow(run, "vec_id long, deviation long, deviation_exact string, w array<double>")
    share = F.array(*(F.lit(float(x)) for x in whitener.share)).cast("array<double>")
    got = got.select("vec_id", "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    return got.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(whitener.scatter.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, "at").alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
