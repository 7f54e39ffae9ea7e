"""Quality classifier: a weak-label model whose posterior labels train a hashed linear scorer.

Heuristic labellers each vote good, bad or nothing on a text. Expectation-maximisation over the
counts of all vote patterns estimates how each labeller votes on good and on bad texts, without
any labelled row, and gives every pattern the probability that its texts are good. Those posterior
labels train a logistic regression over hashed words and hashed word shapes, whose score decides.

A null text, or one without words, gets no vote, the score 0, and is rejected. Repeated rows are scored each; ties at the
threshold are kept; other columns stay as they are, but for quality_score, weak_label and keep, which
`score` replaces and `keep_good` leaves alone; null or equal keys change nothing but which rows are
in the sample; a very long text is one list of words; with no rows at all nothing is learned or kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_slices, table

GOOD, BAD, PASS = 1, 0, -1
LABELLERS = ("capitals", "odd_signs", "bars", "same_word", "few_words", "sentences")
#: Rows expected in the training sample, its partitions, the scorer's buckets, remembered words.
SAMPLE, PARTS, BUCKETS, REMEMBERED = 10_000, 8, 1 << 12, 300_000
_SHAPE = (re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"))
_TAIL = re.compile(r"[^\w\s.,;:!?'\")\]|]+|!{2,}")


def _shape(word: str) -> str:
    return _SHAPE[2].sub("0", _SHAPE[1].sub("a", _SHAPE[0].sub("A", word)))[:12]


class Words(dict):
    """word -> row of what is known about it; starts anew when it is full.

    hashed: the scorer's buckets of words are kept too, and with weights their worth to the scorer.
    """

    def __init__(self, hashed: bool = True, weights: np.ndarray | None = None):
        self.hashed, self.weights = hashed, weights
        self._make_room(REMEMBERED)

    def _make_room(self, n: int) -> None:
        self.flags, self.buckets, self.worth = np.zeros((n, 4), bool), np.zeros((n, 2), np.int32), np.zeros(n)

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self)
        self.flags[k] = (len(w) > 1 and w.isupper(), _TAIL.search(w) is not None, w == "|", w[-1] in ".!?")
        if self.hashed:
            one, two = 2 + zlib.crc32(w.lower().encode()) % (BUCKETS - 1026), BUCKETS - 1024 + zlib.crc32(_shape(w).encode()) % 1024
            self.buckets[k] = one, two
            if self.weights is not None:
                self.worth[k] = self.weights[one] + self.weights[two]
        return k

    def _look(self, text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, float]:
        """The labellers' votes, the rows and shares of the distinct words, and how much repeats."""
        words = text.split() if text else []
        n = len(words)
        if not n:
            return (PASS,) * len(LABELLERS), np.zeros(0, np.int64), np.zeros(0), 0.0
        counts = Counter(words)
        if len(self) + len(counts) > REMEMBERED:
            self.clear()
            if len(counts) > len(self.flags):
                self._make_room(len(counts))
        rows = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        often = np.fromiter(counts.values(), np.float64, len(counts))
        share = often / n
        upper, odd, bars, ends = (often @ self.flags[rows] / n).tolist()  # whole numbers first: a share at a threshold is exact
        same = sum(map(eq, words, words[1:])) / n
        few = len(counts) / n**0.75
        votes = (
            BAD if n >= 5 and upper >= 0.2 else PASS,
            BAD if n >= 5 and odd >= 0.2 else PASS,
            BAD if n >= 5 and bars >= 0.12 else PASS,
            BAD if n >= 5 and same >= 0.25 else PASS,
            BAD if n >= 30 and few <= 0.25 else PASS,
            BAD if n >= 80 and ends < 0.003 else GOOD if n >= 20 and 0.015 <= ends <= 0.3 else PASS,
        )
        return votes, rows, share, same + max(0.0, 0.5 - few)

    def votes(self, text: str | None) -> tuple[int, ...]:
        return self._look(text)[0]

    def read(self, text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
        """The labellers' votes, and the buckets and values of the scorer's features (buckets can repeat)."""
        votes, rows, share, repeats = self._look(text)
        if not len(rows):
            return votes, np.zeros(1, np.int32), np.ones(1)
        return votes, np.concatenate(([0, 1], self.buckets[rows].ravel())).astype(np.int32), np.concatenate(([1.0, repeats], np.repeat(share, 2)))

    def score(self, text: str | None) -> tuple[tuple[int, ...], float]:
        """The votes and the scorer's probability that the text is good; 0 without words."""
        votes, rows, share, repeats = self._look(text)
        if not len(rows):
            return votes, 0.0
        x = self.weights[0] + self.weights[1] * repeats + share @ self.worth[rows]
        return votes, float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class WeakLabels:
    """P(vote | class) for each labeller and the share of good texts, fitted on pattern counts.

    MAP estimate: the start values count for `belief` times the rows of their class.
    """

    def __init__(self, patterns: list[tuple], counts: list[int], rounds: int = 60, belief: float = 2.0):
        self.p_good = 0.8
        m = len(LABELLERS)
        # Start: labellers are right more often than not (places: pass, bad, good).
        self.p = np.empty((2, m, 3))
        self.p[GOOD], self.p[BAD] = (0.5, 0.005, 0.495), (0.45, 0.25, 0.3)
        start = self.p.copy()
        if not patterns:
            return
        v, w = np.array(patterns) + 1, np.array(counts, np.float64)
        for _ in range(rounds):
            good = self._posterior(v)
            for k, weight in ((GOOD, w * good), (BAD, w * (1 - good))):
                for j in range(m):
                    c = np.bincount(v[:, j], weights=weight, minlength=3) + belief * weight.sum() * start[k, j] + start[k, j]
                    self.p[k, j] = c / c.sum()
            self.p_good = float(np.clip((w * good).sum() / w.sum(), 0.05, 0.99))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        at = np.arange(v.shape[1])
        like = [np.log(self.p[k][at, v]).sum(axis=1) for k in (BAD, GOOD)]
        return 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log((1 - self.p_good) / self.p_good), -500, 500)))

    def posterior(self, patterns: list[tuple]) -> np.ndarray:
        return self._posterior(np.array(patterns).reshape(-1, len(LABELLERS)) + 1)

    def accuracies(self) -> dict[str, float]:
        """The share of a labeller's votes that agree with the class."""
        share = np.array([1 - self.p_good, self.p_good])
        right = share[GOOD] * self.p[GOOD, :, GOOD + 1] + share[BAD] * self.p[BAD, :, BAD + 1]
        wrong = share[GOOD] * self.p[GOOD, :, BAD + 1] + share[BAD] * self.p[BAD, :, GOOD + 1]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist(), strict=True))


def _fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 12, rate: float = 0.2, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by AdaGrad over the rows in the order given; a row counts by its class's share."""
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    good = sum(y for *_, y in rows)
    weight = (len(rows) / (2 * max(1.0, len(rows) - good)), len(rows) / (2 * max(1.0, good)))
    for _ in range(rounds):
        for b, x, y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[b] @ x, -30, 30)))
            d = (p - y) * (weight[1] * y + weight[0] * (1 - y)) * x + decay * w[b]
            g[b] += d * d
            w[b] -= rate * d / np.sqrt(g[b])
    return w


class Scorer:
    def __init__(self, labels: WeakLabels, weights: np.ndarray):
        self.labels, self.weights = labels, weights


def _once(buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b, at = np.unique(buckets, return_inverse=True)
    return b, np.bincount(at, weights=values)


def train(docs: DataFrame, key: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Vote patterns are counted over all rows; the scorer is fitted on about `sample` of them.

    A row is in the sample by the hash of its key and text, and copies of a row count once there.
    Partitions are fitted apart and their weights averaged. The driver gets the pattern counts (at most 3^6) and PARTS weight vectors.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = Counter(), Words(hashed=False)
        for b in small_slices(batches):
            counts.update(words.votes(t) for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    found = docs.select(text_col).mapInArrow(vote, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    found = sorted((tuple(r[0]), r[1]) for r in found)
    labels = WeakLabels([f[0] for f in found], [f[1] for f in found])
    total = sum(f[1] for f in found)
    if not total:
        return Scorer(labels, np.zeros(BUCKETS))
    chance = F.pmod(F.xxhash64(F.lit(4), key, text_col), F.lit(1_000_003)) / 1_000_003.0
    share = min(1.0, sample / total)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = Words(), []
        for b in small_slices(batches):
            read = [words.read(t) for t in b.column(1).to_pylist()]
            good = labels.posterior([r[0] for r in read])
            rows += [(h, *_once(*r[1:]), float(y)) for h, r, y in zip(b.column(0).to_pylist(), read, good, strict=True)]
        rows.sort(key=lambda r: r[0])
        if rows:
            w = _fit([r[1:] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([w.astype("<f8").tobytes()], pa.binary())], names=["n", "w"])

    def fitted_on(rows: DataFrame) -> list:
        once = rows.select(F.xxhash64(F.lit(5), key, text_col).alias("h"), text_col).dropDuplicates(["h"])
        return once.repartition(PARTS, "h").mapInArrow(fit, "n long, w binary").collect()

    # no row at all is drawn only where nearly all rows are copies of a few
    fitted = fitted_on(docs.filter(chance < share)) or fitted_on(docs)
    n = sum(r[0] for r in fitted)
    return Scorer(labels, sum((np.frombuffer(r[1], "<f8") * (r[0] / n) for r in sorted(fitted)), np.zeros(BUCKETS)))


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """docs with quality_score, weak_label (posterior of the votes) and keep (score >= threshold)."""
    docs = docs.drop("quality_score", "weak_label", "keep")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(0.0).alias("weak_label"), F.lit(True).alias("keep")).schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, words = shared.value, Words(weights=shared.value.weights)
        for b in small_slices(batches):
            read = [words.score(t) for t in b.column(place).to_pylist()]
            weak = s.labels.posterior([r[0] for r in read])
            got = [r[1] for r in read]
            cols = [*b.columns, pa.array(got, pa.float64()), pa.array(weak), pa.array([x >= threshold and x > 0 for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text reaches the threshold, with the columns that they have."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(weights=shared.value.weights)
        for b in small_slices(batches):
            got = [words.score(t)[1] for t in b.column(place).to_pylist()]
            yield b.filter(pa.array([x >= threshold and x > 0 for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), train(docs)).drop("text")
