"""Target-distribution importance resampling: documents drawn by how much they look like a target text.

Features are the runs of 1 to n consecutive words, joined by one space; a feature's bucket is its
CRC-32 modulo `buckets`. One scan of a text keeps a ring of running CRC states, one for each of the
last n starts: every word extends all of them by a space and itself, starts one anew, and each state
emits a bucket. No feature is ever built as a string, and a long text is read in parts with the ring
carried over.

How often buckets occur in the corpus and in the target gives each bucket's gain, the logarithm of the
ratio of its smoothed shares; a document's weight is the sum of its gains. Gumbel noise from a hash of
the id makes the highest scores a draw without replacement in proportion to exp(weight / 1000). Ranks
come from rows sorted in ranges and the number of rows in the ranges before, so no task holds them all.

A null or empty text has no features and weight 0. A null doc_id has no noise, hence a null score, and
takes no part in the draw, nor in the number of documents it is a share of. Rows with equal doc_id each
have their own weight, score and rank; equal rows have consecutive ranks. An empty corpus gives an empty
table; with an empty target all gains come from the smoothing. Other columns are ignored by `resample`
and kept by `drawn`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, shared_table, small_slices, table, word_parts

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Documents drawn of a hundred, and the words that a document must have.
PERCENT, LEAST_WORDS = 5, 20


class Ring:
    """The running states of the last n starts; `feed` extends them by words and gives all states met."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def feed(self, words: list[bytes]) -> list[int]:
        crc, held, states, out = zlib.crc32, self.n - 1, self.states, []
        for w in words:
            follow = b" " + w
            states = [crc(follow, s) for s in states[-held:]] if held else []
            states.append(crc(w))
            out += states
        self.states = states
        return out


def scan(text: bytes | None, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) of each part of a text."""
    ring = Ring(n)
    for words in word_parts(text or b""):
        yield len(words), np.array(ring.feed(words), np.int64) % buckets


def bucket_counts(texts: DataFrame, n: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket; a task gives one row a bucket, as does the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for b in small_slices(batches):
            for text in b.column(0).to_pylist():
                for _, at in scan(text, n, buckets):
                    count += np.bincount(at, minlength=buckets)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, m in texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = m
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed share in the target to that in the corpus."""
    s, t, size = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = LONGEST, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, words, n_features and weight of every whole text, and columns `more`."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in small_slices(batches):
            words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for k, text in enumerate(b.column("text").to_pylist()):
                for m, at in scan(text, n, len(gain)):
                    words[k] += m
                    features[k] += len(at)
                    weight[k] += gain[at].sum()
            named = [("doc_id", b.column("doc_id")), ("words", pa.array(words)), ("n_features", pa.array(features)), ("weight", pa.array(weight))]
            named += [(name, b.column(name)) for name in b.schema.names if name not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([c for _, c in named], names=[name for name, _ in named])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in ("doc_id", "text"))
    return df.mapInArrow(run, f"doc_id long, words long, n_features long, weight long{extra}")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of the hash of seed and id as u in (0, 1)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], most: Callable[[int], int]) -> DataFrame:
    """rows with `rank` (from 1 by `order`) where it is at most most(their number), else null.

    Rows are sorted in ranges, numbered within a range, and moved on by the rows of the ranges before;
    the driver gets one number for each range.
    """
    part, at = free_name(rows, "range"), free_name(rows, "at_in_range")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() % (1 << 33))
    placed = shared_table(placed, "ranges")
    sizes = sorted(map(tuple, placed.groupBy(part).count().collect()))
    before, offsets = 0, []
    for k, m in sizes:
        offsets.append((k, before))
        before += m
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{part} int, before long"))  # one row a range
    rank = F.col("before") + F.col(at) + 1
    return placed.join(starts, part).withColumn("rank", F.when(rank <= most(before), rank)).drop(part, at, "before")


def scored(docs: DataFrame, target: DataFrame, n: int, buckets: int, seed: int, more: tuple[Column, ...] = ()) -> DataFrame:
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = weigh(docs, gain, n, more)
    return shared_table(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, n: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, more: tuple[Column, ...] = ()
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where the row is not drawn."""
    rows = scored(docs, target, n, buckets, seed, more)
    fits = (F.col("words") >= least_words) & F.col("doc_id").isNotNull()
    # equal keys are dealt over ranges by their other columns and, where those are equal too, by their place in the table
    order = [F.col("score").desc(), F.col("doc_id"), F.col("weight").desc(), F.col("n_features"), *(F.col(c) for c in rows.columns[4:-1])]
    drawn_rows = ranked(rows.filter(fits).withColumn("place", F.monotonically_increasing_id()), [*order, F.col("place")], lambda total: percent * total // 100).drop("place")
    return drawn_rows.unionByName(rows.filter(~fits).withColumn("rank", F.lit(None).cast("long"))).drop("words")


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Of rows with equal doc_id and text all are kept
    if one is drawn."""
    name, own_id, own_text = free_name(docs, "text_hash"), free_name(docs, "drawn_id"), free_name(docs, "drawn_hash")
    picked = resample(docs, target, more=(F.xxhash64("text").alias(name),), **settings).filter("rank IS NOT NULL")
    picked = picked.select(F.col("doc_id").alias(own_id), F.col(name).alias(own_text)).distinct()
    return docs.join(picked, (F.col("doc_id") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_text)), "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 of 100 documents of at least 20 words, drawn towards the texts of `benchmark`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_table() -> list[int]:
    """CRC-32 of each byte, from its polynomial."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


ORACLE_SQL = {
    "op13_importance_resampling": rf"""
WITH w AS (
  SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, true AS corpus, row_number() OVER () AS n FROM documents UNION ALL SELECT NULL, text, false, NULL FROM benchmark)
), f AS (
  SELECT corpus, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w
), c AS (
  SELECT g, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(CAST(strlen(g) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT)),
    lambda s, x: xor(s >> 8, ({_crc_table()}::BIGINT[])[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)
), b AS (SELECT corpus, n, bucket, count(*) AS k FROM f JOIN c USING (g) GROUP BY ALL),
counts AS (SELECT bucket, coalesce(sum(k) FILTER (corpus), 0) AS s, coalesce(sum(k) FILTER (NOT corpus), 0) AS t FROM b GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts
), weights AS (SELECT n, CAST(sum(k) AS BIGINT) AS n_features, CAST(sum(k * gain) AS BIGINT) AS weight FROM b JOIN gains USING (bucket) WHERE corpus GROUP BY 1),
scores AS (
  SELECT doc_id, len(w) >= 20 AND doc_id IS NOT NULL AS fits, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (n) WHERE corpus
), placed AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fits) AS total FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= 5 * total // 100 THEN place END AS rank FROM placed
""",
}
