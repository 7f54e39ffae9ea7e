"""As-of and interval joins that shuffle on time buckets instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, value: str, out: str, width: int = 86_400_000) -> DataFrame:
    """left with the value of the last right row at or before t. A right row at the same time counts as before.

    Rows are sorted within buckets of `width`; what a bucket starts with is the last value of the buckets
    before it, carried along a table of one row for each key and bucket. right needs (key, t, value).
    """
    bucket = F.floor(F.col(t) / width)
    l = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_b", bucket)
    r = right.select(key, t, F.col(value).alias("_value"), F.lit(0).alias("_side"), bucket.alias("_b"))
    w = Window.partitionBy(key, "_b").orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(out, F.last("_value", ignorenulls=True).over(w))
    ends = both.groupBy(key, "_b").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_value")), F.when(F.col("_value").isNotNull(), F.col(t))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    got = both.filter("_side = 1").join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")), "left")
    return got.withColumn(out, F.coalesce(out, "_carried")).drop("_side", "_value", "_b", "_k", "_c", "_carried")


def nearest_within(left: DataFrame, right: DataFrame, key: str, t: str, target, tolerance: int, value: str, out: str, left_id: list[str]) -> DataFrame:
    """left with the value of the latest right row whose t lies in target -+ tolerance.

    Both sides meet on buckets as wide as the whole interval, of which at most two hold it.
    """
    width = 2 * tolerance + 1
    l = left.withColumn("_lo", target - tolerance).withColumn("_hi", target + tolerance)
    l = l.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))))
    r = right.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(t) / width).alias("_b"))
    met = l.join(r, (l[key] == r["_k"]) & (l["_b"] == r["_b"]) & (r["_t"] >= l["_lo"]) & (r["_t"] <= l["_hi"]))
    best = met.groupBy(*left_id).agg(F.max_by("_v", "_t").alias(out))
    return left.join(best, left_id, "left")


def merged_intervals(hits: DataFrame, t: str, reach: int) -> DataFrame:
    """Disjoint [lo, hi] that cover t -+ reach of all hits of a series (gaps and islands)."""
    w = Window.partitionBy("series").orderBy(t)
    h = hits.select("series", t).withColumn("new", F.coalesce((F.col(t) - F.lag(t).over(w) > 2 * reach).cast("int"), F.lit(1)))
    h = h.withColumn("island", F.sum("new").over(w))
    return h.groupBy("series", "island").agg((F.min(t) - reach).alias("lo"), (F.max(t) + reach).alias("hi")).drop("island")
