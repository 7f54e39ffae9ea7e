"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes one blank, and its runs of one to three
characters are hashed into buckets. Training counts buckets by language on a bounded sample of
labelled texts; the matrix of log probabilities goes to the tasks, which score a batch of texts as
sparse products (gather the rows of the buckets, add them up by text) of at most CELLS numbers, so
a very long text or a great many languages need no more memory.

`und` with score 0 where the text is null or has no letter, or where nothing was learned. Ties go
to the first language by name. Repeated rows are scored each; in training, a language of more than
`sample` rows that are all copies of one row is learned from all or none of them. More than
MOST_LANGS languages are an error. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

BUCKETS, LONGEST = 1 << 15, 3
#: Labelled texts for each language that are expected in the training sample, and its partitions.
SAMPLE, PARTS = 10_000, 32
#: Characters of a batch that are hashed at once, numbers that are gathered at once, and languages (134 MB of numbers).
CHARS_AT_ONCE, CELLS, MOST_LANGS = 4_000_000, 8_000_000, 512
_NOT_LETTERS = re.compile(r"[\W\d_]+")
# Fixed odd multipliers that mix the characters of a run.
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters(text: str | None) -> str:
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not clean.isascii() and not clean.replace(" ", "a").isalpha():  # numerals that are no digits, as in "\u00bd \u2167"
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return f" {clean} "


def hashed_runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text numbers) of the runs of each length; a run never crosses two texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    h = np.zeros(len(codes), np.uint32)
    for n in range(LONGEST):
        h = h[: len(h) - 1] if n else h
        h = (h ^ codes[n:]) * _MIX[n]
        h = h ^ (h >> np.uint32(15))
        whole = owner[: len(h)] == owner[n:]
        yield (h[whole] >> np.uint32(3)) & np.uint32(BUCKETS - 1), owner[: len(h)][whole]


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHARS_AT_ONCE:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Model:
    def __init__(self, langs: list[str], log_prior: np.ndarray, log_prob: np.ndarray):
        self.langs, self.log_prior, self.log_prob = langs, log_prior, log_prob  # log_prob[bucket, lang]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [_letters(t) for t in texts]
        score = np.tile(self.log_prior, (len(texts), 1))
        for a, b in _spans(clean):
            for buckets, owners in hashed_runs(clean[a:b]):
                step = max(1, CELLS // max(1, len(self.langs)))
                for at in range(0, len(buckets), step):
                    bucket, owner = buckets[at : at + step], owners[at : at + step]
                    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    score[a + owner[new]] += np.add.reduceat(self.log_prob[bucket], new, axis=0, dtype=np.float64)
        best = score.argmax(axis=1) if self.langs else np.zeros(len(texts), int)
        none = [not self.langs or not c.strip() for c in clean]
        share = 1.0 / np.exp(np.minimum(score - score.max(axis=1, keepdims=True), 0)).sum(axis=1) if self.langs else np.zeros(len(texts))
        return ["und" if x else self.langs[k] for x, k in zip(none, best, strict=True)], [0.0 if x else float(s) for x, s in zip(none, share, strict=True)]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Priors come from all labelled rows; bucket counts from about `sample` rows of each language.

    A row is in the sample by the hash of its key. The driver gets one row of counts for each
    language and training partition, both bounded: PARTS * languages * BUCKETS numbers at most.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MOST_LANGS + 1).collect()}
    langs = sorted(totals)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages in {lang_col}, more than {MOST_LANGS}")
    if not langs:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    shares = F.broadcast(labelled.sparkSession.createDataFrame([(name, min(1.0, sample / n)) for name, n in totals.items()], "sampled_lang string, share double"))
    chance = F.pmod(F.xxhash64(F.lit(77), "key", "text"), F.lit(1_000_003)) / 1_000_003.0
    place = {name: k for k, name in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS * len(langs), np.int64)
        for b in batches:
            texts, of = [_letters(t) for t in b.column(1).to_pylist()], np.array([place[x] for x in b.column(0).to_pylist()])
            for first, last in _spans(texts):
                for bucket, owner in hashed_runs(texts[first:last]):
                    count += np.bincount(bucket.astype(np.int64) * len(langs) + of[first:last][owner], minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array([count.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    parts = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key).alias("key")).join(shares, F.col("lang") == F.col("sampled_lang")).filter(chance < F.col("share")).select("lang", "text").repartition(PARTS).mapInArrow(run, "counts binary").toLocalIterator()
    count = sum((np.frombuffer(r[0], "<i8").astype(np.float64) for r in parts), np.zeros(BUCKETS * len(langs))).reshape(BUCKETS, len(langs))
    n = np.array([totals[x] for x in langs], np.float64)
    return Model(langs, np.log(n / n.sum()), np.log((count + smoothing) / (count.sum(axis=0) + smoothing * BUCKETS)))


def identify(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                langs, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), "text")
    return df.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs, train(docs.filter(~held_out)), held_out)
