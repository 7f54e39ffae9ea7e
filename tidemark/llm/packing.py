"""Packing: vector bin packing of documents into training sequences.

Every document is a vector of tokens, segments and loss-bearing tokens. A sequence takes, again
and again, the waiting document whose vector has the largest dot product with what is left of the
sequence's limits, among those that fit in every dimension; then one document is cut to fill it.
A document may be cut anywhere. A sequence that must close short is closed at a power of two and
its rest waits on, so that no sequence needs padding.

Tasks pack the rows they read in the order they read them, hold a bounded number of waiting
documents, and write full sequences. What is left of a task (less than a sequence, if only the
tokens limit it) is a tail. Tails are dealt over tasks that get TAILS sequences' worth of them each
and are packed once more, so short sequences come only at the end of those, or where the limits on
segments or loss-bearing tokens close one.

Null text is the empty text: its one piece is the end id. Rows with equal or null doc_id are
packed each. An empty table gives no piece. Further columns are ignored.
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
from tidemark.llm.common import shared_table, small_slices, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
LEFT = PIECES + ", ids binary"
#: Documents that wait in a task to be chosen, sequences' worth of tails in a task, and the first sequence of tails.
WAITING, TAILS, TAIL_SEQUENCES = 512, 256, 1 << 60


class Packer:
    """One task's waiting documents and the pieces of the sequences it closes."""

    def __init__(self, limit: int, segments: int, loss_limit: int, first_sequence: int):
        self.caps = np.array([limit, segments, loss_limit], np.float64)
        self.limit, self.next = limit, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids, loss), and for each the ids before its open rest
        self.need = np.zeros((0, 3))
        self.at: list[int] = []
        self.out: list[tuple] = []

    def add(self, doc, ids: memoryview, loss: int, at: int = 0) -> None:
        self.docs.append((doc, ids, loss))
        self.at.append(at)
        self.need = np.vstack([self.need, self._need(-1)])

    def waiting(self) -> int:
        return int(self.need[:, 0].sum())

    def _need(self, k: int) -> np.ndarray:
        """Loss-bearing ids are a document's last ones; a piece is counted by its share of them."""
        _, ids, loss = self.docs[k]
        n = len(ids) // 4
        return np.array([n - self.at[k], 1, min(loss, n - self.at[k])], np.float64)

    def _loss(self, k: int, start: int, length: int) -> int:
        _, ids, loss = self.docs[k]
        return max(0, start + length - max(start, len(ids) // 4 - loss))

    def _room(self, left: np.ndarray) -> np.ndarray:
        """Ids of every document's rest that still go into a sequence with so much left."""
        rest, loss = self.need[:, 0], self.need[:, 2]
        return np.minimum(np.minimum(left[0], rest), rest - loss + left[2])

    def _take(self, k: int, length: int, chosen: list, left: np.ndarray) -> None:
        loss = self._loss(k, self.at[k], length)
        chosen.append((k, self.at[k], length, loss))
        self.at[k] += length
        left -= (length, 1, loss)
        self.need[k] = self._need(k)

    def close(self) -> None:
        """Fill one sequence and write its pieces."""
        left, chosen = self.caps.copy(), []
        share = self.need / self.caps
        while left[0] >= 1 and left[1] >= 1:
            fits = (self.need[:, 0] > 0) & (self.need <= left).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (left / self.caps), -1.0)))
            self._take(k, int(self.need[k, 0]), chosen, left)
        while left[0] >= 1 and left[1] >= 1:  # a cut fills what is left
            room = self._room(left)
            k = int(np.argmax(room))
            if room[k] < 1:
                break
            self._take(k, int(room[k]), chosen, left)
        total = sum(c[2] for c in chosen)
        keep = total if total == self.limit else 1 << (total.bit_length() - 1)
        offset = 0
        for k, start, length, loss in chosen:
            used = min(length, keep - offset)
            if used < length:  # the rest waits on
                self.at[k] = min(self.at[k], start + used)
                self.need[k] = self._need(k)
            if used > 0:
                doc, ids, _ = self.docs[k]
                self.out.append((doc, start, used, zlib.crc32(ids[4 * start : 4 * (start + used)]), len(ids) // 4, self.next, offset, self._loss(k, start, used)))
                offset += used
        self.next += 1
        stay = self.need[:, 0] > 0
        self.docs, self.at = [d for d, s in zip(self.docs, stay, strict=True) if s], [a for a, s in zip(self.at, stay, strict=True) if s]
        self.need = self.need[stay]


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, limit: int = 4096, segments: int = 256, loss_limit: int | None = None, loss_column: str | None = None) -> DataFrame:
    """Pieces of sequences. loss_column: loss-bearing ids at a document's end (null or none: all)."""
    if min(limit, segments, loss_limit or limit) < 1:
        raise ValueError("every limit must be at least 1")
    file = tokens.tokenizer_path(tokenizer)
    tail = struct.pack("<I", end_id)
    names = [f.split()[0] for f in LEFT.split(", ")]
    types = [pa.int64()] * (len(names) - 1) + [pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def pieces(packer: Packer) -> pa.RecordBatch:
        rows, packer.out = [(*r, None) for r in packer.out], []
        return batch(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sequences; a tail is a row with ids, its document's place in `start` and loss-bearing ids in loss_tokens."""
        encode = tokens.word_level_ids(file)
        packer = Packer(limit, segments, loss_limit or limit, TaskContext.get().partitionId() << 33)
        for b in small_slices(batches):
            losses = b.column(2).to_pylist() if loss_column else [None] * b.num_rows
            for doc, got, loss in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), losses, strict=True):
                ids = memoryview(got + tail)
                n = len(ids) // 4
                packer.add(doc, ids, n if loss is None else max(0, min(int(loss), n)))
                while len(packer.docs) > WAITING or packer.docs and packer.need[-1, 0] > limit:
                    packer.close()
            if packer.out:
                yield pieces(packer)
        while packer.waiting() >= limit:
            packer.close()
        if packer.out:
            yield pieces(packer)
        left = [(doc, at, len(ids) // 4 - at, None, len(ids) // 4, None, None, loss, ids[4 * at :].tobytes()) for (doc, ids, loss), at in zip(packer.docs, packer.at, strict=True)]
        if left:
            yield batch(left)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limit, segments, loss_limit or limit, TAIL_SEQUENCES + (TaskContext.get().partitionId() << 33))
        for b in small_slices(batches):
            for r in b.to_pylist():
                packer.add(r["doc_id"], Rest(r["ids"], r["start"]), r["loss_tokens"], r["start"])
                while len(packer.docs) > WAITING:
                    packer.close()
            if packer.out:
                yield pieces(packer)
        while packer.docs:
            packer.close()
        if packer.out:
            yield pieces(packer)

    columns = ["doc_id", "text", *([loss_column] if loss_column else [])]
    done = shared_table(docs.select(*columns).mapInArrow(whole, LEFT), "packed")
    left = done.filter("ids IS NOT NULL")
    count = left.agg(F.sum("length")).first()[0] or 0
    again = left.repartition(max(1, -(-count // (limit * TAILS))), F.xxhash64("doc_id", "start", "ids_crc32", "ids"))
    return done.filter("ids IS NULL").drop("ids").unionByName(again.mapInArrow(tails, LEFT).drop("ids"))


class Rest:
    """The last ids of a document, sliced and measured as the whole document is."""

    def __init__(self, ids: bytes, at: int):
        self.ids, self.before = memoryview(ids), 4 * at

    def __len__(self) -> int:
        return len(self.ids) + self.before

    def __getitem__(self, part: slice) -> memoryview:
        return self.ids[part.start - self.before : part.stop - self.before]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packed_conversations(spark: SparkSession, sf_dir: str, limit: int = 2048, loss_limit: int = 768) -> DataFrame:
    """Turns of `conversations` packed under all three limits: only what the assistant says bears loss.

    doc_id is 10000 * conv_id + turn. With half of all turns bearing loss the third limit binds.
    """
    turns = table(spark, sf_dir, "conversations")
    names = (F.col("conv_id") * 10_000 + F.col("turn")).alias("doc_id")
    rows = turns.select(names, "text", F.when(F.col("role") == "assistant", None).otherwise(0).alias("bears"))
    return pack(rows, limit=limit, loss_limit=loss_limit, loss_column="bears")
