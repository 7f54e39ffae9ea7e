"""Token-ID / binary output: patched frame-of-reference blocks.

A segment is one file image: magic, counts, the start of every block, then the blocks. A block
holds up to 1024 ids as its minimum, a bit width chosen so that a stated share of the ids fits,
the packed low bits of (id - minimum), and the ids that do not fit as an exception list of places
and high bits. Segments are rows of a Parquet table in the shared folder, so any store that Spark
writes can hold them; beside each stands which documents it has and how many ids each takes.

A segment has at most about twice SEGMENT_IDS ids: it closes once it holds so many, and a longer
document is written in parts, one segment each, whose checksums are joined when they are read.

Null text is the empty text; a null doc_id sorts first; rows with equal doc_id are ordered by a
hash of their text and written each; further columns are ignored; an empty table writes no segment
and reads none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import shared_path, small_slices, table

MAGIC, BLOCK, HEAD = b"PFOR1\0\0\0", 1024, struct.Struct("<8sQIf")
#: Share of a block's ids that its bit width must hold, ids after which a segment is closed, blocks whose bits are unpacked at once.
FITTING, SEGMENT_IDS, UNPACKED = 0.95, 1 << 18, 64


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _some(which: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(which), UNPACKED):
        yield which[at : at + UNPACKED]


def encode_segment(ids: np.ndarray, fitting: float = FITTING) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[(blocks - 1) * BLOCK :].min()
    v = full.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = v - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(fitting * BLOCK)) - 1))
    width = _bits(np.partition(rest, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    high = rest >> np.minimum(width, 31)[:, None].astype(np.uint32)
    high[width == 32] = 0
    where, place = np.nonzero(high)
    over = high[where, place]
    ends = np.searchsorted(where, np.arange(blocks + 1))
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width[width > 0]):
        for which in _some(np.flatnonzero(width == w)):
            bits = np.unpackbits(rest[which].astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :w]
            packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
            for k, row in zip(which, packed, strict=True):
                bodies[k] = row.tobytes()
    for k in range(blocks):
        a, b = ends[k], ends[k + 1]
        bodies[k] = struct.pack("<IBH", int(low[k]), int(width[k]), b - a) + bodies[k] + place[a:b].astype("<u2").tobytes() + over[a:b].astype("<u4").tobytes()
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))[:blocks].astype("<u8")
    return b"".join([HEAD.pack(MAGIC, n, blocks, fitting), starts.tobytes(), *bodies])


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default), found by the index of block starts."""
    magic, n, blocks, _ = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    starts = np.frombuffer(data, "<u8", blocks, HEAD.size)
    base, last = HEAD.size + 8 * blocks, blocks if last is None else min(last, blocks)
    out = np.empty((max(0, last - first), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBH", data, base + int(starts[k])) for k in range(first, last)]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        size = BLOCK * int(w) // 8
        for which in _some(np.flatnonzero(width == w)):
            if w == 0:
                out[which] = 0
                continue
            packed = np.stack([np.frombuffer(data, np.uint8, size, base + int(starts[first + k]) + 7) for k in which])
            bits = np.zeros((len(which) * BLOCK, 32), np.uint8)
            bits[:, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, w)
            out[which] = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little").view("<u4").reshape(len(which), BLOCK)
    for k, (low, w, m) in enumerate(heads):
        if m:
            at = base + int(starts[first + k]) + 7 + BLOCK * w // 8
            out[k, np.frombuffer(data, "<u2", m, at)] |= np.frombuffer(data, "<u4", m, at + 2 * m) << np.uint32(w)
        out[k] += np.uint32(low)
    return out.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, both with their bits in its order (first bit: 1)."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n: int) -> int:
    """CRC-32 of two strings joined, from theirs and the length n of the second."""
    power, square, left = 1 << 31, 1 << 23, n  # 1, and a shift by one byte
    while left:
        if left & 1:
            power = _times(power, square)
        square, left = _times(square, square), left >> 1
    return _times(power, first) ^ second


SEGMENTS = "shard int, segment int, before long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary, part int, of int"


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, fitting: float = FITTING) -> None:
    """Encode every text and write the segments, in ascending doc_id order: shards are ranges of doc_id.

    part, of: null, or which part a segment is of the one document whose first part is segment `of`.
    """
    file = tokens.tokenizer_path(tokenizer)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = tokens.byte_level_ids(file), TaskContext.get().partitionId()
        ids: list[bytes] = []
        names: list = []
        sizes: list[int] = []
        done = number = held = 0

        def segment(names: list, sizes: list[int], data: bytes, part: int | None = None, of: int | None = None) -> pa.RecordBatch:
            nonlocal done, number
            n = len(data) // 4
            row = {"shard": shard, "segment": number, "before": done, "n_ids": n, "doc_ids": names, "doc_tokens": sizes, "payload": encode_segment(np.frombuffer(data, "<u4"), fitting), "part": part, "of": of}
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32())
            done, number = done + n, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for b in small_slices(batches, 64):
            for doc, got in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                n = len(got := got + tail) // 4
                if sizes and (n > SEGMENT_IDS or held >= SEGMENT_IDS):
                    yield segment(names, sizes, b"".join(ids))
                    ids, names, sizes, held = [], [], [], 0
                if n <= SEGMENT_IDS:
                    ids.append(got)
                    names.append(doc)
                    sizes.append(n)
                    held += n
                    continue
                of = number
                for part, at in enumerate(range(0, n, SEGMENT_IDS)):
                    some = got[4 * at : 4 * (at + SEGMENT_IDS)]
                    yield segment([doc], [len(some) // 4], some, part, of)
        if sizes:
            yield segment(names, sizes, b"".join(ids))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ordered.select("doc_id", "text").mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the segments.

    The driver holds one number for each shard, that is for each task of the writing job.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = sorted(tuple(r) for r in segments.groupBy("shard").agg(F.sum("n_ids")).collect())
    starts, at = {}, 0
    for shard, n in totals:
        starts[shard] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, 1):
            row = b.to_pylist()[0]
            data = memoryview(decode_segment(row["payload"]).astype("<u4", copy=False)).cast("B")
            ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
            begins = ends - np.asarray(row["doc_tokens"], np.int64)
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
            cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + (starts[row["shard"]] + row["before"])), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())]
            m = len(crc)
            cols += [pa.array([row[c]] * m, pa.int32()) for c in ("shard", "of", "part")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "of", "part"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = []
            for parts in b.column("parts").to_pylist():
                crc = 0
                for p in parts:
                    crc = joined_crc(crc, p["ids_crc32"], 4 * p["n_tokens"])
                joined.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(joined, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(some: DataFrame) -> DataFrame:
        return some.select("shard", "before", "doc_ids", "doc_tokens", "payload", "of", "part").mapInArrow(run, READ + ", shard int, of int, part int")

    parts = read(segments.filter("part IS NOT NULL")).groupBy("shard", "of").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "n_tokens", "ids_crc32"))).alias("parts")
    )
    long = parts.select("doc_id", "start", "n_tokens", "parts").mapInArrow(whole, READ)
    return read(segments.filter("part IS NULL")).select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(long)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
