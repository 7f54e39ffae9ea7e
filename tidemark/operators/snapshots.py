"""Snapshots of bin edges that are frozen: reused while young and complete, else computed anew and appended under a version.

The table is append-only, one folder a version, which a run that is repeated overwrites with the same rows. A version of a
series is valid from when it was made until the next one of that series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats

# How long a snapshot stays frozen, changes that edges need, shares at which they lie.
FREEZE_MS, LEAST, SHARES = 30 * 86_400_000, 10, (0.2, 0.4, 0.6, 0.8)


class Snapshots:
    """Edges by key and channel. `ensure` gives what is in force at a time, and computes only what is due."""

    def __init__(self, path: str, key: str = "series", channels: int = 3):
        self.path, self.key, self.channels, self.versions = path, key, channels, []

    def table(self, spark: SparkSession, but: str | None = None) -> DataFrame | None:
        """key, channel, n, edges, created and version of every snapshot made, but those of one version."""
        versions = [v for v in self.versions if v != but]
        if not versions:
            return None
        return spark.read.option("basePath", self.path).schema(f"{self.key} long, channel string, n long, edges array<double>, created long, version string").parquet(*(f"{self.path}/version={v}" for v in versions))

    def latest(self, spark: SparkSession, but: str | None = None) -> DataFrame | None:
        """The newest snapshot of each key."""
        made = self.table(spark, but)
        if made is None:
            return None
        newest = F.max("created").over(Window.partitionBy(self.key))
        return made.withColumn("newest", newest).filter(F.col("created") == F.col("newest")).drop("newest")

    def ensure(self, changes: DataFrame, now: int) -> DataFrame:
        """changes: (key, channel, dl) that were known at `now`. A key without a snapshot, with a channel missing, or whose snapshot
        is 30 days old is computed again; where its changes are too few the old one stays in force."""
        spark, version = changes.sparkSession, f"v{now}"
        before = self.latest(spark, version)  # a run that is repeated makes its version again
        if before is not None:
            kept = before.groupBy(self.key).agg(F.count("*").alias("have"), F.max("created").alias("made")).filter((F.col("have") >= self.channels) & (now - F.col("made") < FREEZE_MS))
            changes = changes.join(kept.select(self.key), self.key, "left_anti")
        fresh = changes.groupBy(self.key, "channel").agg(F.count("dl").alias("n"), F.sort_array(F.collect_list("dl")).alias("all")).filter(F.col("n") >= LEAST)
        fresh = fresh.select(self.key, "channel", "n", stats.quantiles(F.col("all"), SHARES).alias("edges"))
        fresh.withColumn("created", F.lit(now).cast("long")).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        if version not in self.versions:
            self.versions.append(version)
        return self.latest(spark)

    def valid(self, spark: SparkSession, channel: str) -> DataFrame:
        """version and edges of a channel with the time [since, until) in which they hold."""
        made = self.table(spark).filter(F.col("channel") == channel)
        return made.select(self.key, "version", "edges", F.col("created").alias("since"), F.lead("created").over(Window.partitionBy(self.key).orderBy("created")).alias("until"))


def at_their_time(rows: DataFrame, valid: DataFrame, key: str, time: Column) -> DataFrame:
    """rows with the version valid at their time, null before the first: a join on key and interval, of at most one match.
    A key has one version in 30 days, so a row meets few."""
    v = valid.select(F.col(key).alias("of_key"), "version", "edges", "since", "until")
    inside = (F.col(key) == F.col("of_key")) & (time >= F.col("since")) & (F.col("until").isNull() | (time < F.col("until")))
    return rows.join(v, inside, "left").drop("of_key", "since", "until")
