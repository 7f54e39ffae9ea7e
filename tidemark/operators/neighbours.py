"""The k most similar vectors by cosine, of every query: a join that prunes by pivots and the triangle inequality.

Vectors are brought to length 1, where similarity is 1 - d^2 / 2. Copies of a vector are one point with its smallest ids,
and one question. Each point belongs to the cell of its nearest pivot; a cell's summary is how many points it has and how
far they reach. A question is first put to its own cell, whose k-th neighbour there is a distance that the answer surely
keeps; a further cell is needed only if neither its reach nor the plane between its pivot and the question's own puts it
beyond that distance. Cells and questions are kept in blocks of bounded size, a pair of blocks is one matrix product, and
large cells are dealt by a salt. The driver holds the pivots and one summary for each, about as many as the root of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shared import written

#: Pivots at most; rows of a block of data and of queries; rows of a cell that share a salt; partitions over which copies of a vector are dealt.
MOST_PIVOTS, ROWS, ASKED, SALTED, SALTS = 4096, 1024, 256, 16_384, 16
#: Similarities are compared to this many digits, ties by the smaller id; what rounding can add to a squared distance.
DIGITS, SLACK = 6, 4e-6
#: The id that stands where a point has fewer copies than others.
NONE = 2**63 - 1


def units(df: DataFrame, dim: int) -> DataFrame:
    """id and v of length 1: nulls, null or non-finite entries, other lengths and zero vectors take no part; of rows with
    one id the smallest vector stays."""
    v = F.col("v").cast("array<double>")
    usable = F.col("id").isNotNull() & (F.size("v") == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = df.filter(usable).groupBy(F.col("id").cast("long").alias("id")).agg(F.min(v).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return one.withColumn("norm", norm).filter("norm > 0").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _away(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * (x @ p.T)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def copies(points: DataFrame, most: int) -> DataFrame:
    """v and the smallest `most` ids that have it, ascending, filled up with NONE."""
    smallest = lambda ids: F.slice(F.array_sort(ids), 1, most)
    some = points.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(smallest(F.collect_list("id")).alias("ids"))
    whole = some.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.select("v", F.concat("ids", F.array_repeat(F.lit(NONE), most - F.size("ids"))).alias("ids"))


def _blocks(rows: DataFrame, dim: int, size: int, width: int) -> DataFrame:
    """Rows (cell, salt, ids, v) as blocks (cell, salt, ids, vecs) of at most `size` rows of one cell and salt; each row has `width` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            (cell, salt), ids, vecs = held[0][0], *(np.concatenate([h[k] for h in held]) for k in (1, 2))
            values = ([cell], [salt], [ids.astype("<i8").tobytes()], [vecs.astype("<f8").tobytes()])
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["cell", "salt", "ids", "vecs"])

        for b in batches:
            cell, salt, ids, vecs = b.column("cell").to_numpy(), b.column("salt").to_numpy(), _matrix(b.column("ids"), width), _matrix(b.column("v"), dim)
            at = 0
            while at < len(ids):
                key = (int(cell[at]), int(salt[at]))
                if held and (held[0][0] != key or sum(len(h[1]) for h in held) >= size):
                    yield block()
                    held = []
                room = size - sum(len(h[1]) for h in held)
                same = (cell[at : at + room] == key[0]) & (salt[at : at + room] == key[1])
                end = at + (len(same) if same.all() else int(same.argmin()))
                held.append((key, ids[at:end], vecs[at:end]))
                at = end
        if held:
            yield block()

    keys = ["cell", "salt"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select("cell", "salt", "ids", "v").mapInArrow(run, "cell int, salt int, ids binary, vecs binary")


def _best(sim: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and ids of the `most` best pairs of each row, ties by the smaller id; ids: those of each column's copies."""
    order = np.argsort(ids[:, 0])
    score, ids = np.rint(sim[:, order] * 10.0**DIGITS), ids[order]
    if len(ids) > most:  # a point's other copies come after its first, so the best pairs are of the best points
        key = score * len(ids) - np.arange(len(ids))
        at = np.argpartition(key, len(ids) - most, axis=1)[:, -most:]
        score, ids = np.take_along_axis(score, at, 1), ids[at]
    else:
        ids = np.broadcast_to(ids, (len(score), *ids.shape))
    score = np.where(ids == NONE, -np.inf, score[:, :, None]).reshape(len(score), -1)
    ids = ids.reshape(len(ids), -1)
    first = np.lexsort((ids, -score), axis=1)[:, :most]
    return np.take_along_axis(score, first, 1) / 10.0**DIGITS, np.take_along_axis(ids, first, 1)


def most_similar(queries: DataFrame, data: DataFrame, k: int, dim: int, prune: bool = True) -> DataFrame:
    """id, other, similarity and rank of the k most similar rows of data for each query: (id, v) of dim entries both.

    A query does not meet the row of its own id. With fewer rows all are given.
    """
    spark, most = data.sparkSession, k + 1  # one more, for a query can be among its own neighbours
    points, asked = written(copies(units(data, dim), most), "points"), written(units(queries, dim), "asked")
    n = points.count()
    want = min(MOST_PIVOTS, max(16, int(n**0.5)))
    p = np.array([r["v"] for r in points.orderBy(F.xxhash64(F.get("ids", F.lit(0))), F.get("ids", F.lit(0))).limit(want).collect()], np.float64).reshape(-1, dim)
    p = np.unique(p, axis=0) if len(p) else np.zeros((1, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, ROWS):
            away = _away(_matrix(b.column("v"), dim), p)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), b.column("ids"), b.column("v")], names=["cell", "away", "ids", "v"])

    schema = "cell int, away double, ids array<long>, v array<double>"
    placed = written(points.mapInArrow(place, schema), "cells")
    summary = {r["cell"]: (r["n"], r["reach"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()}
    cells = np.array(sorted(summary), np.int64)
    count, reach, centre = np.array([summary[c][0] for c in cells]), np.array([summary[c][1] for c in cells]), p[cells]
    parts = F.broadcast(spark.createDataFrame([(int(c), -(-int(m) // SALTED)) for c, m in zip(cells, count, strict=True)], "cell int, parts int"))  # one row a pivot
    blocks = written(_blocks(placed.join(parts, "cell").withColumn("salt", F.pmod(F.xxhash64("ids"), "parts").cast("int")), dim, ROWS, most), "blocks")

    def answered(rows: DataFrame) -> DataFrame:
        """The best pairs of rows (id, v, cell) within that cell, one row a question and block."""
        dealt = rows.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.array("id").alias("ids"), "v")
        pairs = _blocks(dealt, dim, ASKED, 1).withColumnsRenamed({"ids": "q_ids", "vecs": "q_vecs"}).join(blocks, ["cell", "salt"]).select("q_ids", "q_vecs", "ids", "vecs")

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, 1):
                q_ids, q_vecs, ids, vecs = (b.column(c)[0].as_py() for c in ("q_ids", "q_vecs", "ids", "vecs"))
                sim = np.frombuffer(q_vecs, "<f8").reshape(-1, dim) @ np.frombuffer(vecs, "<f8").reshape(-1, dim).T
                value, other = _best(sim, np.frombuffer(ids, "<i8").reshape(-1, most), most)
                row, col = np.nonzero(np.isfinite(value))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, "<i8")[row]), pa.array(other[row, col]), pa.array(value[row, col])], names=["id", "other", "similarity"])

        return pairs.mapInArrow(solve, "id long, other long, similarity double")

    # copies of a query are one question, by the smallest id
    some = asked.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("id"))
    distinct = some.groupBy("v").agg(F.array(F.min("id")).alias("ids"))
    groups = written(distinct.mapInArrow(place, schema).select("cell", "away", F.get("ids", F.lit(0)).alias("id"), "v"), "groups")
    near = written(answered(groups), "near")
    worst = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("similarity"), False), most, 1).alias("kth"))
    bounded = groups.join(worst, "id", "left").select("id", "v", "cell", F.get("kth", F.lit(0)).alias("kth"))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, ASKED):
            x, own = _matrix(b.column("v"), dim), b.column("cell").to_numpy()
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            away = _away(x, centre) if len(cells) else np.zeros((len(x), 0))
            use = np.ones(away.shape, bool)
            if prune and len(cells):
                far = away + reach
                order = np.argsort(far, axis=1)
                enough = np.cumsum(count[order], axis=1) >= most
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
                sure = np.where(enough.any(axis=1), np.take_along_axis(np.take_along_axis(far, order, 1), at[:, None], 1)[:, 0] ** 2, np.inf)
                sure = np.fmin(sure, 2 - 2 * kth)
                apart = _away(p[own], centre)
                home = ((x - p[own]) ** 2).sum(axis=1)[:, None]
                plane = np.where(apart > 1e-4, (away**2 - home) / (2 * np.maximum(apart, 1e-4)), 0.0)
                lowest = np.maximum(np.maximum(0.0, away - reach), plane)
                use = lowest**2 <= sure[:, None] + SLACK
            at, wanted = np.nonzero(use)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(x) + 1)).astype(np.int32)), pa.array(cells[wanted].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("cell"), lists], names=["id", "v", "own", "cells"])

    questions = written(bounded.mapInArrow(needs, "id long, v array<double>, own int, cells array<int>"), "questions")
    others = questions.select("id", "v", "own", F.explode("cells").alias("cell")).filter("cell <> own").drop("own")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    found = near.unionByName(answered(others)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    lists = groups.select("v", F.col("id").alias("of")).join(found.withColumnRenamed("id", "of"), "of").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "similarity"))).alias("found"))
    each = asked.join(lists, "v").withColumn("found", F.slice(F.filter("found", lambda x: x["other"] != F.col("id")), 1, k))
    return each.select("id", F.posexplode("found").alias("pos", "x")).select("id", "x.other", "x.similarity", (F.col("pos") + 1).alias("rank"))


def voted(found: DataFrame, labels: DataFrame) -> DataFrame:
    """id and voted: the label that most of its neighbours have, null on a tie. labels: (other, label), null labels do not vote."""
    per = found.join(labels.filter(F.col("label").isNotNull()), "other").groupBy("id", "label").agg(F.count("*").alias("votes"))
    per = per.withColumn("place", F.rank().over(Window.partitionBy("id").orderBy(F.desc("votes"))))
    return per.groupBy("id").agg(F.when(F.count_if(F.col("place") == 1) == 1, F.max(F.when(F.col("place") == 1, F.col("label")))).alias("voted"), F.max("votes").alias("votes"))
