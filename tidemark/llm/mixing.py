"""Mixing sources to target weights: Poisson replication with column expressions only.

Source s with n_s of all N documents and target share w_s has the mean repetition rate
w_s * N / n_s. Every document draws a count from the Poisson distribution of that mean by
inverting it at a uniform number hashed from its key and the seed, is exploded by its count, and
the copies are shuffled globally by a hashed key. All draws repeat exactly for the same seed.

No rate is capped. Up to the rate SHORT the law's steps are sent along with the source; above it each
document adds them up from 12 deviations below the mean (what lies below is under 1e-31, the draws
have 52 bits), so no array is longer than about 24 deviations. Counts above BLOCK are exploded in
blocks, which are dealt out before they become copies.

A null source is a source of its own. Sources without a weight are left out when weights are
given; without weights all sources get equal shares. Rows with equal keys draw equal counts and
are each replicated. Other columns are kept; if one is named like `mix_copy` or `mix_key`, those get
underscores added. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, table

#: Sources whose rates may be sent to all tasks, with at most 180 steps each (14 MB); more of them are joined by a salted shuffle.
MOST_SOURCES, SALTS = 10_000, 64
#: The largest rate whose steps are kept in an array, and the most copies that a row is exploded into at once.
SHORT, BLOCK = 64, 4096


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _last(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("long")


def poisson_steps(rate: Column) -> Column:
    """The distribution function of the Poisson law at 0, 1, 2, ... until its tail is negligible; for short rates."""
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(a: Column, k: Column) -> Column:
        log_p = a["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        total = a["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(a["steps"], F.array(total)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), _last(rate)), start, step, lambda a: a["steps"])


def poisson_count(rate: Column, u: Column) -> Column:
    """How many steps of the distribution function of a long rate's law are at most u.

    Probabilities are taken as p(m) times ratios from the mode m, with Stirling's series for p(m), so
    that nothing of the size of the rate is added up.
    """
    mode = F.floor(rate)
    m = mode.cast("double")
    d = (rate - m) / m
    # ln p(m) = m ln(rate) - rate - ln m!, with m ln(rate / m) - (rate - m) = m (ln(1 + d) - d)
    log_mode = m * (F.log1p(d) - d) - 0.5 * F.ln(F.lit(2 * math.pi) * m) - 1 / (12 * m) + 1 / (360 * m * m * m)
    first = F.greatest(F.lit(0).cast("long"), F.floor(rate - 12 * F.sqrt(rate)).cast("long"))
    # from the mode down to the first step, then up from there
    down = F.aggregate(F.sequence(first, mode.cast("long")), F.lit(0.0), lambda a, k: a + F.when(k > first, F.log1p((k.cast("double") - rate) / rate)).otherwise(F.lit(0.0)))
    start = F.struct((log_mode + down).alias("log_p"), F.lit(0.0).alias("sum"), first.alias("n"))

    def step(a: Column, k: Column) -> Column:
        log_p = a["log_p"] + F.when(k > first, -F.log1p((k.cast("double") - rate) / rate)).otherwise(F.lit(0.0))
        total = a["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), (a["n"] + F.when(total <= u, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("n"))

    return F.aggregate(F.sequence(first, _last(rate)), start, step, lambda a: a["n"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source") -> DataFrame:
    """mix_source, rate and, up to SHORT, the steps of its Poisson law. weights: (source, weight), at least one above 0."""
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    if weights is None:
        shares = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col(weights.columns[0]).alias("of"), F.col(weights.columns[1]).cast("double").alias("weight")).filter("weight > 0")
        shares = counts.join(w, F.col("mix_source").eqNullSafe(F.col("of"))).drop("of")
    whole = shares.agg(F.sum("weight").alias("whole"))
    rates = shares.join(F.broadcast(total)).join(F.broadcast(whole))  # one row each
    rates = rates.select("mix_source", (F.col("weight") / F.col("whole") * F.col("total") / F.col("n")).alias("rate"))
    return rates.withColumn("steps", F.when(F.col("rate") <= SHORT, poisson_steps(F.least("rate", F.lit(float(SHORT))))))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 7, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Every column of docs with mix_copy (from 1) and mix_key, in the order of mix_key within partitions."""
    copy, order = free_name(docs, "mix_copy"), free_name(docs, "mix_key")
    of, steps, salt, times, rate, block = (free_name(docs, x) for x in ("mix_source", "mix_steps", "mix_salt", "mix_times", "mix_rate", "mix_block"))
    rates = source_rates(docs, weights, source).select(F.col("mix_source").alias(of), F.col("steps").alias(steps), F.col("rate").alias(rate))
    sources, top = rates.agg(F.count("*"), F.max(rate)).first()
    if sources <= MOST_SOURCES:
        joined = docs.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col(of)))
    else:  # many sources: each is split over SALTS partitions, so a hot one does not meet in one task
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, F.col(source).eqNullSafe(F.col(of)) & (left[salt] == salted[salt])).drop(salted[salt]).drop(salt)
    u = uniform(seed, F.col(key))
    count = F.size(F.filter(steps, lambda s: s <= u)).cast("long")
    if (top or 0) > SHORT:
        count = F.when(F.col(rate) <= SHORT, count).otherwise(poisson_count(F.col(rate), u))
    copies = joined.withColumn(times, count).drop(steps, of, rate).filter(F.col(times) > 0)
    if (top or 0) > BLOCK / 2:  # counts can pass BLOCK only from here on, at 12 deviations
        many = F.col(times) > BLOCK
        blocks = copies.filter(many).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / BLOCK))))
        blocks = blocks.repartition(F.xxhash64(F.col(key), F.col(block)))
        first, last = F.col(block) * BLOCK + 1, F.least(F.col(times), (F.col(block) + 1) * BLOCK)
        copies = copies.filter(~many).withColumn(block, F.lit(0).cast("long")).unionByName(blocks)
        copies = copies.withColumn(copy, F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop(times, block)
    else:
        copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(times)
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(copy).cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return copies.withColumn(order, place).repartition(order).sortWithinPartitions(order)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op7_mixing": """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
steps(source, k, log_p, total) AS (
  SELECT source, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT s.source, s.k + 1, s.log_p + ln(r.rate) - ln((s.k + 1)::DOUBLE), s.total + exp(s.log_p + ln(r.rate) - ln((s.k + 1)::DOUBLE))
  FROM steps s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source WHERE s.k < ceil(r.rate + 12 * sqrt(r.rate) + 20)
), drawn AS (
  SELECT d.*, CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.total <= d.u) AS copies FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS mix_copy,
  CAST('0x' || substr(md5('order7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || c), 1, 13) AS BIGINT) AS mix_key
FROM (SELECT *, unnest(generate_series(1, copies)) AS c FROM counted WHERE copies > 0)
""",
}
