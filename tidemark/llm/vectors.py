"""Vector search: an exact top-k join by Voronoi cells, and an inverted multi-index.

Both group vectors in cells, keep each cell as blocks of bounded size, send to a group of queries
the cells that it needs, and solve every (query block, data block) pair with one matrix product.
A block is one row, so a cell that holds a third of all vectors is just many blocks, dealt by a
salt over the tasks. What a query block needs is told by keys (block, cell, salt), which meet the
blocks in two joins. A task keeps only the best k of each query it has seen.

Vectors that are null or hold null or non-finite components take no part; vectors of unequal
length count as padded with zeros; repeated ids are each a candidate, except for a query of their
own id, and of query rows with one id the smallest vector (component by component) asks; ties go to
the smaller id; with fewer candidates than k all are given; further columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table, table

#: Rows of a data block and of a query block, vectors of a cell that share a salt, those whose queries do, and queries that share a group.
DATA_ROWS, QUERY_ROWS, SALT_ROWS, ASKED_ROWS, ASKED = 1024, 512, 8192, 32_768, 512
#: Entries of a cell of the multi-index.
LISTED = 4096
BLOCKS = "cell int, n long, reach double, ids binary, vecs binary"
ASKED_BLOCKS = "q_ids binary, q_vecs binary, stops binary, cells array<int>"
PAIRS = ("q_ids", "q_vecs", "stops", "ids", "vecs", "codes")


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    df = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    df = df.filter(F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    return df if zero else df.filter(F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(ids: dict[int, list], vecs: dict[int, list], cells: list[int], centre: np.ndarray | None) -> pa.RecordBatch:
    rows = []
    for c in cells:
        i, v = np.concatenate(ids.pop(c)), np.concatenate(vecs.pop(c))
        reach = float(np.sqrt(((v - centre[c]) ** 2).sum(axis=1)).max()) if centre is not None else 0.0
        rows.append((c, len(i), reach, i.astype("<i8").tobytes(), v.astype("<f8").tobytes()))
    cols = list(zip(*rows, strict=True))
    types = (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["cell", "n", "reach", "ids", "vecs"])


def in_blocks(df: DataFrame, cells_of: Callable[[np.ndarray], np.ndarray], dim: int, rows: int, centre: np.ndarray | None = None) -> DataFrame:
    """Blocks of at most `rows` vectors of one cell, made by the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list] = {}
        vecs: dict[int, list] = {}
        held: dict[int, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                i, v = part.column("id").to_numpy(zero_copy_only=False), matrix(part.column("v"), dim)
                cells = cells_of(v) if "cell" not in part.schema.names else part.column("cell").to_numpy(zero_copy_only=False)
                full = []
                for c in np.unique(cells).tolist():
                    mine = cells == c
                    if held.get(c, 0) + int(mine.sum()) > rows and c in ids:
                        yield _blocks(ids, vecs, [c], centre)
                        held[c] = 0
                    ids.setdefault(c, []).append(i[mine])
                    vecs.setdefault(c, []).append(v[mine])
                    held[c] = held.get(c, 0) + int(mine.sum())
                    full += [c] if held[c] >= rows else []
                if full:
                    yield _blocks(ids, vecs, full, centre)
                    held |= dict.fromkeys(full, 0)
        if ids:
            yield _blocks(ids, vecs, list(ids), centre)

    return df.mapInArrow(run, BLOCKS)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2.0 * (v @ centres.T), axis=1)


def _best(q: np.ndarray, i: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of each q with the smallest (key, i)."""
    order = np.lexsort((i, key, q))
    qs = q[order]
    first = np.concatenate(([0], np.flatnonzero(qs[1:] != qs[:-1]) + 1)) if len(qs) else np.zeros(0, np.int64)
    rank = np.arange(len(qs)) - np.repeat(first, np.diff(np.append(first, len(qs))))
    return order[rank < k]


def solve(pairs: DataFrame, dim: int, k: int, products: bool, exact_floats: bool = True, parts: Callable | None = None) -> DataFrame:
    """pairs (q_ids, q_vecs, stops, ids, vecs, codes) -> query_id, rank, vec_id, score over all pairs.

    products: largest inner product of whole numbers; else smallest Euclidean distance.
    parts(q, stops, codes): places of queries, slices of rows and which of these rows each of those queries looks at;
    only they are multiplied (without it each query looks at every row).
    """
    kind = "long" if products else "double"

    def pair(q_ids, q, ids, x, seen=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = q_ids[:, None] == ids[None, :]
        if seen is not None:
            out |= ~seen
        if products:
            score = (q @ x.T).astype(np.int64) if exact_floats else q.astype(np.int64) @ x.astype(np.int64).T
            rough, slack = np.where(out, np.inf, -score.astype(np.float64)), 0.0
        else:
            size = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
            rough, slack = np.where(out, np.inf, size - 2.0 * (q @ x.T)), 1e-9 * float(size.max())
        n = min(k, rough.shape[1])
        last = np.partition(rough, n - 1, axis=1)[:, n - 1 : n]
        a, b = np.nonzero((rough <= last + slack) & ~out)
        key = score[a, b] if products else np.sqrt(((q[a] - x[b]) ** 2).sum(axis=1))
        at = _best(a, ids[b], -key if products else key, k)
        return q_ids[a[at]], ids[b[at]], key[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def best() -> tuple:
            q, i, key = (np.concatenate(c) for c in zip(*held, strict=True))
            at = _best(q, i, -key if products else key, k)
            return q[at], i[at], key[at]

        for b in batches:
            for q_ids, q_vecs, stops, ids, vecs, codes in zip(*(b.column(n).to_pylist() for n in PAIRS), strict=True):
                q_ids, q, ids, x = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_vecs, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8"), np.frombuffer(vecs, "<f8").reshape(-1, dim)
                if parts is None:
                    got = [pair(q_ids, q, ids, x)]
                else:
                    got = [pair(q_ids[a], q[a], ids[c], x[c], seen) for a, c, seen in parts(q, np.frombuffer(stops, "<f8"), np.frombuffer(codes, "<i4").reshape(-1, 2))]
                held += got
                count += sum(len(g[0]) for g in got)
                if count > 400_000:
                    held = [best()]
                    count = len(held[0][0])
                    if count > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["query_id", "vec_id", "score"])
                        held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], names=["query_id", "vec_id", "score"])

    found = pairs.select(*PAIRS).mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if products else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(spark: SparkSession, sizes: dict[int, int], rows: int) -> DataFrame:
    """parts: how many parts of about `rows` vectors a cell has; one row for each cell, so at most as many as pivots."""
    return F.broadcast(spark.createDataFrame([(c, -(-n // rows)) for c, n in sizes.items()], "cell int, parts int"))


def _salted(rows: DataFrame, sizes: dict[int, int], key: str, most: int) -> DataFrame:
    """salt: which of its cell's parts a row belongs to."""
    return rows.join(_parts(rows.sparkSession, sizes, most), "cell").withColumn("salt", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")


def neighbourhoods(centres: np.ndarray, groups: int) -> np.ndarray:
    """A group of each centre: equal shares of them along the direction in which they vary most."""
    off = centres - centres.mean(axis=0)
    along = off @ np.linalg.svd(off, full_matrices=False)[2][0]
    rank = np.empty(len(centres), np.int64)
    rank[np.argsort(along, kind="stable")] = np.arange(len(centres))
    return rank * min(groups, len(centres)) // len(centres)


def met(queries: DataFrame, blocks: DataFrame, cell_of: Callable[[np.ndarray], np.ndarray], look: Callable[[np.ndarray], tuple], dim: int, sizes: dict[int, int], centres: np.ndarray) -> DataFrame:
    """Pairs of query blocks and data blocks. sizes: vectors of each cell.

    Queries of near cells share blocks, about ASKED in each group or more where there are more of them
    than cells; hot groups are dealt by salt. Of rows with one id the smallest vector asks. look(q) gives
    where each query of a block stops and the cells that the block needs; these become keys
    (block, cell, salt), one for each part of a cell.
    """
    spark = queries.sparkSession
    once = shared_table(queries.groupBy("id").agg(F.min("v").alias("v")), "asking")
    group = neighbourhoods(centres, max(1, -(-once.count() // ASKED)))
    of_group = np.bincount(group, weights=[sizes.get(c, 0) for c in range(len(centres))]).astype(np.int64)

    def to_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(group[cell_of(matrix(b.column("v"), dim))].astype(np.int32)))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, vecs in enumerate(b.column("vecs").to_pylist()):
                stops, cells = look(np.frombuffer(vecs, "<f8").reshape(-1, dim))
                cols = [b.column("ids").slice(k, 1), b.column("vecs").slice(k, 1), pa.array([np.asarray(stops, "<f8").tobytes()], pa.binary()), pa.array([np.asarray(cells, np.int32)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["q_ids", "q_vecs", "stops", "cells"])

    placed = _salted(once.mapInArrow(to_group, "id long, v array<double>, cell int"), {c: max(1, int(m)) for c, m in enumerate(of_group)}, "id", ASKED_ROWS)
    made = in_blocks(placed.repartition("cell", "salt").select("id", "v", "cell"), None, dim, QUERY_ROWS).mapInArrow(asks, ASKED_BLOCKS)
    asked = shared_table(made.withColumn("block", F.sha2("q_ids", 256)), "queries")
    keys = asked.select("block", F.explode("cells").alias("cell")).join(_parts(spark, sizes, SALT_ROWS), "cell")
    keys = keys.select("block", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    data = _salted(blocks, sizes, "ids", SALT_ROWS).select("cell", "salt", "ids", "vecs")
    return keys.join(asked.drop("cells"), "block").join(data, ["cell", "salt"]).withColumn("codes", F.lit(b""))


def pivots_of(df: DataFrame, dim: int, most: int, n: int) -> np.ndarray:
    """About sqrt(n)/8 vectors, at least 4 and at most `most`, taken by the order of their hashed id."""
    want = min(most, max(4, int(n**0.5 / 8)))
    got = df.orderBy(F.xxhash64("id"), "id").limit(want).collect()
    out = np.zeros((len(got), dim))
    for k, r in enumerate(got):
        out[k, : len(r["v"])] = r["v"]
    return np.unique(out, axis=0)


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", max_pivots: int = 4096) -> DataFrame:
    """The k largest inner products of floor(scale * x) for every query, against all other vectors.

    A cell's summary is its pivot, how many vectors it has and how far they reach from the pivot.
    For a query q and a cell with pivot p and reach r every product lies in q.p -+ |q| r, so the
    cells with the largest lower ends that together hold k + (rows of one id) vectors give a value
    that the k-th best surely has; a cell whose upper end is below it is not needed. A group of
    queries gets the cells that any of its queries needs. The driver holds at most max_pivots
    pivots and summaries. Scores must fit a long.
    """
    whole = usable(vectors, id_col, vec_col, True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    stats = whole.agg(F.max(F.size("v")), F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    dim, n = max(1, stats[0] or 1), stats[1]
    exact_floats = (stats[2] or 0.0) ** 2 * dim < 2.0**52
    p = pivots_of(whole, dim, max_pivots, n)
    if not len(p):
        p = np.zeros((1, dim))
    blocks = shared_table(in_blocks(whole, lambda v: nearest(v, p), dim, DATA_ROWS, p), "cells")
    summary = {r[0]: (r[1], r[2]) for r in blocks.groupBy("cell").agg(F.sum("n"), F.max("reach")).collect()}
    most_of_one_id = whole.filter(is_query).groupBy("id").count().agg(F.max("count")).first()[0] or 1
    cells = np.array(sorted(summary), np.int64)
    count, reach, centre = np.array([summary[c][0] for c in cells]), np.array([summary[c][1] for c in cells]), p[cells]

    def look(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, give = q @ centre.T, np.sqrt((q**2).sum(axis=1))[:, None] * reach[None, :]
        give = give * (1 + 1e-9) + 1e-6
        low, high = middle - give, middle + give
        order = np.argsort(-low, axis=1)
        enough = np.cumsum(count[order], axis=1) >= k + most_of_one_id
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(cells) - 1)
        sure = np.where(enough.any(axis=1), np.take_along_axis(np.take_along_axis(low, order, 1), at[:, None], 1)[:, 0], -np.inf)
        return np.zeros(0), cells[(high >= sure[:, None]).any(axis=0)]

    sizes = {int(c): int(m) for c, m in zip(cells, count, strict=True)}
    return solve(met(whole.filter(is_query), blocks, lambda v: nearest(v, p), look, dim, sizes, p), dim, k, True, exact_floats)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means of the rows of x, started from evenly spaced rows."""
    c = x[np.unique(np.linspace(0, len(x) - 1, min(size, len(x))).astype(int))].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Pairs:
    """The centroid pairs (i, j) and how many entries they hold. sizes[i, j]; far: how far an entry lies from its pair at most."""

    def __init__(self, sizes: np.ndarray, far: float = np.inf):
        self.sizes, self.far = sizes, far

    def reach(self, a: np.ndarray, b: np.ndarray, enough: int, k: int = 0) -> tuple[float, list[int]]:
        """Traverses pairs in the order of a[i] + b[j], by a heap over first halves, until they hold `enough` entries.

        a, b: a query's squared distances to the centroids of each half. Only these two lists are sorted. A first half
        enters the heap when its nearest pair could be next, and pairs without entries are passed over. Where entries
        lie near their centroids it stops sooner: when no later pair can hold one of the k nearest. Returns the sum at
        which it stops, and the first halves of the pairs it has visited.
        """
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sorted_a, sorted_b = a[by_a], b[by_b]
        heap: list[tuple[float, int, int]] = []
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen: set[int] = set()
        opened, total, last, bound = 0, 0, -np.inf, np.inf
        while total < enough:
            while opened < len(a) and (not heap or sorted_a[opened] + sorted_b[0] <= heap[0][0]):
                row = int(by_a[opened])
                held = self.sizes[row, by_b]
                some = np.flatnonzero(held)
                if len(some):
                    lists[row] = sorted_a[opened] + sorted_b[some], held[some]
                    heapq.heappush(heap, (float(lists[row][0][0]), row, 0))
                opened += 1
            if not heap:
                break
            s, row, at = heap[0]
            if s > bound:
                break
            last = s
            sums, held = lists[row]
            total += int(held[at])
            seen.add(row)
            if bound == np.inf and 0 < k <= total:
                # k entries lie within sqrt(s) + far of the query, and later ones beyond sqrt(sum) - far
                bound = (max(s, 0.0) ** 0.5 + 2 * self.far) ** 2
            if at + 1 < len(sums):
                heapq.heapreplace(heap, (float(sums[at + 1]), row, at + 1))
            else:
                heapq.heappop(heap)
        return last, sorted(seen)


class MultiIndex:
    """An inverted multi-index of vectors: codebooks of both halves, and lists of entries by neighbouring first halves.

    The codebooks are fitted on at most `sample` vectors; every vector is indexed. Each half has `half_size` centroids, by
    default n / 20 up to 512 and the root of n beyond, up to 1024. First halves that lie near each other share a cell of about
    LISTED entries, whose blocks are ordered by pair.
    """

    def __init__(self, real: DataFrame, half_size: int | None = None, sample: int = 30_000):
        stats = real.agg(F.max(F.size("v")), F.count("*")).first()
        self.dim, self.n = max(2, stats[0] or 2), stats[1]
        dim, n, cut = self.dim, self.n, self.dim // 2
        size = half_size or min(max(8, n // 20), max(512, int(n**0.5)), 1024)
        rows = real.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toPandas()["v"].tolist() if n else []
        x = np.zeros((len(rows), dim))
        for r, v in enumerate(rows):
            x[r, : len(v)] = v
        self.left, self.right = left, right = codebook(x[:, :cut], size), codebook(x[:, cut:], size)
        self.cell = cell = neighbourhoods(left, max(1, -(-n // LISTED)))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for ids, vecs in zip(b.column("ids").to_pylist(), b.column("vecs").to_pylist(), strict=True):
                    ids, v = np.frombuffer(ids, "<i8"), np.frombuffer(vecs, "<f8").reshape(-1, dim)
                    i, j = nearest(v[:, :cut], left), nearest(v[:, cut:], right)
                    order = np.lexsort((j, i))
                    off = ((v - np.concatenate([left[i], right[j]], axis=1)) ** 2).sum(axis=1)
                    out.append((ids[order].tobytes(), v[order].tobytes(), np.stack([i, j], axis=1)[order].astype("<i4").tobytes(), float(np.sqrt(off.max()))))
                cols = [b.column("cell"), b.column("n"), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.float64())))]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "n", "ids", "vecs", "codes", "far"])

        made = in_blocks(real, lambda v: cell[nearest(v[:, :cut], left)], dim, DATA_ROWS)
        self.blocks = shared_table(made.mapInArrow(coded, "cell int, n long, ids binary, vecs binary, codes binary, far double"), "lists")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(left) * len(right), np.int64)
            for b in batches:
                for codes in b.column("codes").to_pylist():
                    at = np.frombuffer(codes, "<i4").reshape(-1, 2).astype(np.int64)
                    held += np.bincount(at[:, 0] * len(right) + at[:, 1], minlength=len(held))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["pair", "n"])

        sizes = np.zeros(len(left) * len(right), np.int64)
        for r in self.blocks.select("codes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
            sizes[r[0]] = r[1]  # at most one row for each pair of centroids
        far = self.blocks.agg(F.max("far")).first()[0]
        self.pairs = Pairs(sizes.reshape(len(left), len(right)), 0.0 if far is None else far)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of queries to the centroids of each half."""
        cut = self.dim // 2
        square = lambda x, c: np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2.0 * (x @ c.T))
        return square(q[:, :cut], self.left), square(q[:, cut:], self.right)

    def parts(self, q: np.ndarray, stops: np.ndarray, codes: np.ndarray) -> Iterator[tuple]:
        """Of a block ordered by pair: for each first half the queries that visit any of its pairs there, its rows, and which
        of them each query visits."""
        a, b = self.distances(q)
        cuts = [0, *(np.flatnonzero(codes[1:, 0] != codes[:-1, 0]) + 1).tolist(), len(codes)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            seen = a[:, codes[lo, 0], None] + b[:, codes[lo:hi, 1]] <= stops[:, None]
            mine = np.flatnonzero(seen.any(axis=1))
            if len(mine):
                yield mine, slice(lo, hi), seen[mine]

    def asked(self, queries: DataFrame, enough: int, need: int) -> DataFrame:
        """Blocks of queries (cell, q_ids, q_vecs, stops, read) for each cell that they visit; read: how many entries the first halves
        hold that a query visits, over all cells. Of rows with one id the smallest vector asks."""
        once = shared_table(queries.groupBy("id").agg(F.min("v").alias("v")), "asking")
        shared = queries.sparkSession.sparkContext.broadcast((self.pairs, self.cell, self.left, self.right, self.dim))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, cell, left, right, dim = shared.value
            bare = object.__new__(MultiIndex)
            bare.left, bare.right, bare.dim = left, right, dim
            of_first = pairs.sizes.sum(axis=1)
            for b in batches:
                for at in range(0, b.num_rows, QUERY_ROWS):
                    part = b.slice(at, QUERY_ROWS)
                    ids, q = part.column("id").to_numpy(), matrix(part.column("v"), dim)
                    stops, firsts = zip(*(pairs.reach(x, y, enough, need) for x, y in zip(*bare.distances(q), strict=True)), strict=True)
                    # a hair more, as a product of another shape rounds otherwise
                    stops, cells = np.array(stops) * (1 + 1e-9), [np.unique(cell[f]) for f in firsts]
                    read = np.array([of_first[f].sum() for f in firsts])
                    for c in np.unique(np.concatenate(cells)).tolist():
                        who = np.array([c in x for x in cells])
                        cols = ([c], [ids[who].astype("<i8").tobytes()], [q[who].astype("<f8").tobytes()], [stops[who].astype("<f8").tobytes()], [read[who].astype("<i8").tobytes()])
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), *(pa.binary(),) * 4), strict=True)], names=["cell", "q_ids", "q_vecs", "stops", "read"])

        return shared_table(once.mapInArrow(run, "cell int, q_ids binary, q_vecs binary, stops binary, read binary"), "queries")

    def search(self, queries: DataFrame, k: int, enough: int, need: int) -> DataFrame:
        """The k nearest of each query among the entries it visits, of which `need` hold k that are not its own. A cell's blocks are dealt by a salt, and only queries travel."""
        spark = queries.sparkSession
        held = np.bincount(self.cell, weights=self.pairs.sizes.sum(axis=1)).astype(np.int64)
        sizes = {c: int(m) for c, m in enumerate(held) if m}
        if not sizes:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = self.asked(queries, enough, need).join(_parts(spark, sizes, SALT_ROWS), "cell")
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "q_ids", "q_vecs", "stops")
        data = _salted(self.blocks, sizes, "ids", SALT_ROWS).select("cell", "salt", "ids", "vecs", "codes")
        bare = object.__new__(MultiIndex)
        bare.left, bare.right, bare.dim = self.left, self.right, self.dim
        return solve(asked.join(data, ["cell", "salt"]), self.dim, k, False, parts=bare.parts)


def multi_index_search(vectors: DataFrame, is_query, k: int = 10, half_size: int | None = None, probe: float = 0.2, least: int = 1000, sample: int = 30_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of every query among the entries of the centroid pairs it visits, by exact distance.

    A query visits pairs until they hold max(least, probe * all) entries, or until no later pair can hold one of its k nearest;
    only these entries are ranked. On uniform directions without structure 0.2 gives a recall of 0.9; there all but few cells are
    visited. Where vectors lie in clusters a query reads the entries of few first halves.
    """
    real = usable(vectors, id_col, vec_col, False)
    index = MultiIndex(real, half_size, sample)
    # rows of a query's own id are no neighbours, so as many more entries must be seen
    own = real.filter(is_query).groupBy("id").count().agg(F.max("count")).first()[0] or 1
    return index.search(real.filter(is_query), k, max(least, int(probe * index.n)) + k + own, k + own)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE_SQL = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
