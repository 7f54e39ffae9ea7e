"""Helpers that the corpus operators share: inputs, shared tables, Arrow batches, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task holds as Python objects at once, and bytes of a text that are cut into words at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_roots: dict[str, str] = {}
_written: list[str] = []
#: Partitions over which the rows of one key are dealt.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a session in one process gets a temporary folder, and any other an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which `dropped_after` removes, or else the end of the driver."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that shared_path gave, by the file system that it is in."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextlib.contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared tables written inside, when what was made of them has been written elsewhere."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            drop_path(spark, path)
        del _written[before:]


def with_totals(df: DataFrame, group: str, row: Column, part: dict[str, Column], whole: dict[str, Column], then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """df with aggregates of its group attached, without a group in one task.

    The rows of a group are dealt over SALTS partitions by the hash of `row`: `part` aggregates them there,
    `whole` the (at most SALTS) partial rows of a group, and each partition gets its own copy of the result.
    `then` can add columns to the one row of each group.
    """
    salt = free_name(df, "salt")
    df = df.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    parts = df.groupBy(group, salt).agg(*(c.alias(k) for k, c in part.items()))
    total = parts.groupBy(group).agg(F.collect_list(salt).alias("_salts"), *(c.alias(k) for k, c in whole.items()))
    total = then(total).withColumn(salt, F.explode("_salts")).drop("_salts")
    return df.join(total, [group, salt]).drop(salt)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# Letters and digits stay, A-Z become small, every other ASCII character separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in parts of bounded size, cut between words."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + BYTES_AT_ONCE)
        part = text[begin:end].translate(WORD_BYTES)
        cut = len(part)
        if end < len(text):
            cut = part.rfind(b" ") + 1
            while not cut and end < len(text):  # one word longer than a part
                more = text[end : end + BYTES_AT_ONCE].translate(WORD_BYTES)
                end += len(more)
                part, cut = part + more, more.rfind(b" ") + 1
                cut = cut and len(part) - len(more) + cut
            cut = cut or len(part)
        yield part[:cut].split()
        begin += cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between nodes of any ordered type -> (node, component) with the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes. Every step is an aggregation
    and a join on the node, dealt by salt, so a node with very many links is not one task; each round's
    links are a table in the shared folder, and the round before is deleted.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = with_totals(e, "a", F.col("b"), {"low": F.min("b")}, {"low": F.min("low")}).withColumn("low", F.least("a", "low"))
        if large:
            out = both.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = both.select(F.col("b").alias("a"), F.col("low").alias("b")).union(both.select("a", F.col("low").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = shared_table(edges.filter("a <> b").select("a", "b").distinct(), "links")
    was = None
    while True:
        old = _written[-1]
        edges = shared_table(star(star(edges, True), False), "stars")
        drop_path(spark, old)
        _written.remove(old)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
