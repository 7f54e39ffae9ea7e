"""N-gram Jaccard join: rare-first prefix filtering, verified once, down to linked groups.

The set of a text is its distinct hashed n-grams, and a 128-bit hash names it. Two texts link when
their Jaccard similarity reaches `percent` / 100. Equal sets are one class from the start, with a number
that is the node of all links. For sets of different names:

1. how often n-grams occur is counted over all texts, in a table of fixed size (2^22 counters);
2. the n-grams of a set are ordered rarest first, and as two linked sets must share one of the
   first |x| - ceil(t|x|) + 1, only these are joined;
3. rows that share a prefix n-gram meet in one partition, where pairs must pass the length,
   positional and suffix filters. The suffix filter bounds what two sets share after that n-gram
   by how many n-grams their suffixes have in each of 128 slices of the hash range; the first
   n-gram that two sets share is the one at which the bound must hold. Of each meeting only links
   that connect something new are passed on, so a group of m copies gives m - 1 rows, not all pairs;
4. the sets of each group so connected are brought together and each pair is verified exactly at
   most once, again skipping pairs that are already connected; components of the verified links
   are the result.

Meetings and groups over a bounded number of rows are cut in blocks, and each two blocks meet
(pairs of one block are tested where it meets itself), so no task holds an unbounded group and no
link is lost. Copies of one set, links of one node and members of one group are dealt by a salt.

The rows, bytes and time of a text grow in proportion to its length, of whatever length it is: a pair of texts of
a million words is tested. A null or empty text has an empty set and is linked with nothing. A row is a node: rows with equal
doc_id and different texts can lie in different components, each under the smallest doc_id of its
own; the result is the same for any partitioning. A null doc_id is reported with its own null
component and takes no part in links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, free_name, shared_table, small_slices, table, with_totals

#: Counters of n-gram frequency, slices of the hash range in the suffix filter.
COUNTERS, SLICES = 1 << 22, 128
#: Rows that share an n-gram and texts of a group that meet at once, and the n-grams of such texts.
MEETING, GROUP, GROUP_GRAMS = 1024, 1024, 4_000_000
#: Prefix n-grams whose slice counts are made at once.
WALKED = 8192
#: Members of groups that are sent to all tasks (of 40 bytes each); more are joined by a shuffle.
FEW = 1_000_000
_PARTS = 64  # of the counter table
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams; fewer than n words count as one n-gram."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = _mix(out * _A + h[j : len(h) - k + 1 + j] * _B + np.uint64(j))
    return np.unique(_mix(out + np.uint64(k)))


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often n-grams occur in all texts, by the low bits of their hash, on a scale of 0 to 255.

    Every task counts its texts; parts of the table are added up by the tasks of a second stage.
    The driver gets COUNTERS bytes, whatever the input.
    """
    size = COUNTERS // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for b in small_slices(batches):
            grams = [gram_set(t, n) for t in b.column(0).to_pylist()]
            place, often = np.unique((np.concatenate(grams) & np.uint64(COUNTERS - 1)).astype(np.uint32), return_counts=True)
            seen[place] += often.astype(np.uint32)
        if seen.any():
            short = np.minimum(seen, 65535).astype("<u2").reshape(_PARTS, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([r.tobytes() for r in short], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, np.zeros(size, np.uint64)) + np.frombuffer(counts, "<u2")
        scale = {k: np.minimum(255, np.rint(16 * np.log2(v.astype(np.float64) + 1))).astype(np.uint8) for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(scale), pa.int32()), pa.array([v.tobytes() for v in scale.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((_PARTS, size), np.uint8)
    added = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(16, "part").mapInArrow(add, "part int, counts binary")
    for part, counts in added.collect():
        out[part] = np.frombuffer(counts, np.uint8)
    return out.reshape(-1)


SUMMARY = "doc_id long, text_hash long, n long, key binary, prefix array<long>, slices binary, sig binary"


def _slice(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(57)).astype(np.uint8)


def summaries(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Size, 128-bit name, rare-first prefix with its slices, and slice counts of the set of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in small_slices(batches):
            sizes, keys, prefixes, slices, sigs = [], [], [], [], []
            for t in b.column(2).to_pylist():
                g = gram_set(t, n)
                m = len(g)
                first = g[np.lexsort((g, often[(g & np.uint64(COUNTERS - 1)).astype(np.int64)]))][: m + (-percent * m // 100) + 1] if m else g
                sizes.append(m)
                keys.append(xxhash.xxh3_128_digest(g.tobytes()))
                prefixes.append(first.view(np.int64))
                slices.append(_slice(first).tobytes())
                sigs.append(np.minimum(255, np.bincount(_slice(g), minlength=SLICES)).astype(np.uint8).tobytes())
            cols = [*b.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(slices, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n", "key", "prefix", "slices", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SUMMARY)


def in_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            last[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(last)
        same = not held or all(held[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            whole = b.slice(0, int(cuts[-1]))
            yield pa.Table.from_batches([*held, whole])
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _run_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(new), [t.num_rows]))


def _walk(side: np.ndarray | None, m: int, linked) -> list[tuple[int, int]]:
    """Links of a forest over m rows; linked(i, others) says which of the others row i links to.

    side: block of each row where two blocks meet; then only pairs of different blocks are tested.
    """
    if side is None:
        left, out = [np.arange(m)], []
        other = lambda i: 0
    else:
        left, out = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)], []
        other = lambda i: 1 - int(side[i])
    for own in range(len(left)):
        while len(left[own]):
            todo, left[own] = [left[own][0]], left[own][1:]
            while todo:
                i = todo.pop()
                k = other(i)
                if not len(left[k]):
                    continue
                hit = linked(i, left[k])
                out += [(int(i), int(j)) for j in left[k][hit]]
                todo += left[k][hit].tolist()
                left[k] = left[k][~hit]
    return out


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = sorted({(min(p), max(p)) for p in found if p[0] != p[1]})
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _blocks(df: DataFrame, total, most: int) -> DataFrame:
    """bi, bj, side: every two blocks of a run of `total` rows meet, each row in all meetings of its block."""
    nb = F.ceil(F.col(total) / F.lit(float(most))).cast("int")
    df = df.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    df = df.withColumn("side", F.when(F.col("block") <= F.col("other"), 0).otherwise(1))
    return df.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("nb", "block", "other")


def _side(t: pa.Table, a: int, b: int) -> np.ndarray | None:
    """The blocks of the rows of one meeting, or None where a block meets itself."""
    if t.column("bi")[a].as_py() == t.column("bj")[a].as_py():
        return None
    return t.column("side").slice(a, b - a).to_numpy()


def _suffixes(places: list[np.ndarray], slices: list[bytes], sigs: list[bytes], begin: int = 0, used: np.ndarray | None = None) -> np.ndarray:
    """Slice counts of sets after each of their ascending prefix places; a count of 255 may be more and stays.

    begin, used: for a part of one set's places, where the part before ended and the counts up to there.
    """
    sizes = np.array([len(x) for x in places])
    first = np.concatenate(([0], np.cumsum(sizes)))
    cells = [(first[k] + np.searchsorted(p, np.arange(begin, p[-1] + 1))) * SLICES + np.frombuffer(s, np.uint8, p[-1] + 1 - begin, begin) for k, (p, s) in enumerate(zip(places, slices, strict=True)) if p[-1] >= begin]
    count = np.bincount(np.concatenate(cells) if cells else np.zeros(0, np.int64), minlength=first[-1] * SLICES).reshape(-1, SLICES)
    total = np.cumsum(count, axis=0)
    total -= np.repeat(total[first[:-1]] - count[first[:-1]], sizes, axis=0)  # what the sets before have used
    if used is not None:
        total += used
        used[:] = total[-1]
    sig = np.repeat(np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, SLICES), sizes, axis=0)
    return np.where(sig == 255, 255, sig - total).astype(np.uint8)


def prefix_rows(reps: DataFrame) -> DataFrame:
    """id, n, pos, gram and df of every prefix n-gram that sets share, with the slice counts after it (`sig`).

    Rows of a set come together to walk its prefix once, so they take 128 bytes each however long the text is.
    An n-gram that more than a 4096th of all rows hold is joined by a broadcast of such n-grams, of which there are
    fewer than 4096, so no task gets all rows of one.
    """
    rows = reps.select("id", F.posexplode("prefix").alias("pos", "gram"))
    often = shared_table(rows.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "shared_grams")
    most = max(MEETING, (reps.agg(F.sum(F.size("prefix"))).first()[0] or 0) // 4096)
    hot = F.broadcast(often.filter(F.col("df") > most))
    rest = rows.join(hot.select("gram"), "gram", "left_anti").join(often.filter(F.col("df") <= most), "gram")
    of_set = rest.unionByName(rows.join(hot, "gram")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "gram", "df"))).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = b.column("shared")
            ends = (shared.offsets.to_numpy() - shared.offsets[0].as_py()).tolist()
            pos, gram, df = (shared.flatten().field(c) for c in range(3))
            places, sigs, slices = pos.to_numpy(), b.column("sig"), b.column("slices")

            def rows_of(first: int, last: int, at: int, end: int, sig: np.ndarray, b=b, ends=ends, pos=pos, gram=gram, df=df) -> pa.RecordBatch:
                size = np.diff(np.clip(ends[first : last + 1], at, end))
                cols = [pa.array(np.repeat(b.column(c).slice(first, last - first).to_numpy(), size)) for c in ("id", "n")]
                cols += [c.slice(at, end - at) for c in (pos, gram, df)]
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLICES), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))])
                return pa.RecordBatch.from_arrays([*cols, fixed.cast(pa.binary())], names=["id", "n", "pos", "gram", "df", "sig"])

            first = 0
            while first < b.num_rows:
                last = first + 1
                while last < b.num_rows and ends[last + 1] - ends[first] <= WALKED:
                    last += 1
                if last == first + 1:  # one set, in parts
                    begin, used = 0, np.zeros(SLICES, np.int64)
                    for at in range(ends[first], ends[last], WALKED):
                        end = min(ends[last], at + WALKED)
                        yield rows_of(first, last, at, end, _suffixes([places[at:end]], [slices[first].as_py()], [sigs[first].as_py()], begin, used))
                        begin = int(places[end - 1]) + 1
                else:
                    sets = range(first, last)
                    sig = _suffixes([places[ends[k] : ends[k + 1]] for k in sets], [slices[k].as_py() for k in sets], [sigs[k].as_py() for k in sets])
                    yield rows_of(first, last, ends[first], ends[last], sig)
                first = last

    return of_set.join(reps.select("id", "n", "sig", "slices"), "id").mapInArrow(run, "id long, n long, pos int, gram long, df long, sig binary")


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """Links that connect all pairs which share a prefix n-gram and pass the filters."""
    keys = ["gram", "bi", "bj"]
    met = _blocks(prefix_rows(reps), "df", MEETING).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_runs(batches, keys):
            ids, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "pos"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SLICES)
            bounds = _run_bounds(t, keys)
            sizes = np.diff(bounds)

            def near(i, j, n=n, pos=pos, sig=sig):
                """Length, positional and suffix filters for row numbers i (one or many) and j."""
                a, b = n[i], n[j]
                need = percent * (a + b)
                ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                ok &= (100 + percent) * (1 + np.minimum(a - pos[i], b - pos[j]) - 1) >= need
                x, y = sig[i], sig[j]
                most = 1 + np.minimum(x, y).sum(axis=-1, dtype=np.int64)
                return ok & (((100 + percent) * most >= need) | ((x == 255) & (y == 255)).any(axis=-1))

            found: list[tuple[int, int]] = []
            two = bounds[:-1][sizes == 2]
            for at in range(0, len(two), 20_000):
                i = two[at : at + 20_000]
                hit = i[near(i, i + 1)]
                found += zip(ids[hit].tolist(), ids[hit + 1].tolist(), strict=True)
            for a, b in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
                found += [(int(ids[a + i]), int(ids[a + j])) for i, j in _walk(_side(t, a, b), b - a, lambda i, left, a=a: near(a + i, a + left))]
            if found:
                yield _edges(found)

    return met.select("id", "n", "pos", "sig", "side", *keys).mapInArrow(run, "a long, b long").distinct()


def verified_links(docs: DataFrame, groups: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links that connect what is linked within each group. groups: (node, component)."""
    members = groups.select(F.col("node").alias("id"), F.col("component").alias("grp")).join(reps.select("id", "n", "doc_id", "text_hash"), "id")
    members = with_totals(members, "grp", F.col("id"), {"m": F.count("*"), "grams": F.sum("n")}, {"m": F.sum("m"), "grams": F.sum("grams")})
    weight = F.greatest("m", F.ceil(F.col("grams") * F.lit(GROUP / GROUP_GRAMS)))
    members = shared_table(members.select("id", "doc_id", "text_hash", "grp", weight.alias("weight")), "members")
    few = F.broadcast(members) if members.count() <= FEW else members  # rows of five longs
    # the text of a set: any row of its doc_id and text hash
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(few, ["doc_id", "text_hash"]).dropDuplicates(["id"])
    keys = ["grp", "bi", "bj"]
    met = _blocks(texts, "weight", GROUP).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_runs(batches, keys):
            bounds = _run_bounds(t, keys)
            ids, texts = t.column("id").to_numpy(), t.column("text")
            found: list[tuple[int, int]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [gram_set(texts[k].as_py(), n) for k in range(a, b)]
                size = np.array([len(s) for s in sets], np.int64)
                start = np.concatenate(([0], np.cumsum(size)))
                grams, which = np.unique(np.concatenate(sets), return_inverse=True)
                holders = np.repeat(np.arange(b - a), size)[np.argsort(which, kind="stable")]
                first = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(grams)))))

                def linked(i, left, size=size, start=start, which=which, holders=holders, first=first, m=b - a):
                    of = which[start[i] : start[i + 1]]
                    n_of = first[of + 1] - first[of]
                    at = np.repeat(first[of] - np.concatenate(([0], np.cumsum(n_of)[:-1])), n_of) + np.arange(n_of.sum())
                    common = np.bincount(holders[at], minlength=m)[left]
                    return (100 * common >= percent * (size[i] + size[left] - common)) & (common > 0)

                found += [(int(ids[a + i]), int(ids[a + j])) for i, j in _walk(_side(t, a, b), b - a, linked)]
            if found:
                yield _edges(found)

    return met.select("id", "text", "side", *keys).mapInArrow(run, "a long, b long").distinct()


def _labelled(docs: DataFrame, n: int, percent: int, texts: bool) -> DataFrame:
    """doc_id, text_hash, n and first of every row: the smallest doc_id of its component, or with `texts` the
    smallest (doc_id, text_hash); null where the row takes no part in links."""
    known = shared_table(summaries(docs, n, percent, gram_counts(docs, n)), "sets")
    named = known.filter("n > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), *(F.first(c).alias(c) for c in ("n", "prefix", "slices", "sig")))
    reps = shared_table(reps.select(F.monotonically_increasing_id().alias("id"), "key", "row.*", "n", "prefix", "slices", "sig"), "representatives")
    near = connected_components(candidate_links(reps, percent))
    linked = connected_components(verified_links(docs, near, reps, n, percent)).withColumnRenamed("node", "id")
    name = F.struct("doc_id", "text_hash") if texts else F.col("doc_id")
    linked = linked.join(reps.select("id", "key", "doc_id", "text_hash"), "id")
    linked = with_totals(linked, "component", F.col("key"), {"least": F.min(name)}, {"least": F.min("least")})
    linked = shared_table(linked.select("key", "least"), "labels")
    rows = named.select("key", "doc_id", "text_hash", "n")
    rows = with_totals(rows, "key", F.col("doc_id"), {"low": F.min(name)}, {"low": F.min("low")}, lambda classes: classes.join(linked, "key", "left"))
    rows = rows.select("doc_id", "text_hash", "n", F.coalesce("least", "low").alias("first"))
    return rows.unionByName(known.filter("n = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n"), allowMissingColumns=True)


def linked_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    return _labelled(docs, n, percent, False).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest doc_id (and text hash).

    Of rows with equal doc_id and text one stays; other texts of a doc_id are documents of their own. A null
    doc_id always stays.
    """
    gone, gone_hash, same = free_name(docs, "gone"), free_name(docs, "gone_hash"), free_name(docs, "same_text")
    rows = _labelled(docs, n, percent, True).filter(F.col("first").isNotNull() & (F.struct("doc_id", "text_hash") != F.col("first")))
    rows = rows.select(F.col("doc_id").alias(gone), F.col("text_hash").alias(gone_hash)).distinct()
    kept = docs.join(rows, (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(gone_hash)), "left_anti")
    once = kept.filter("doc_id IS NOT NULL").withColumn(same, F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", same]).drop(same)
    return once.unionByName(docs.filter("doc_id IS NULL"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT l.b, r.seen FROM reach r JOIN links l ON r.node = l.a WHERE r.seen < l.b
), best AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, b.component_id FROM s JOIN best b ON s.doc_id = b.node
""",
}
