"""Token counts: a prefix table by dynamic programming answers truncation and budget questions.

For byte-level merges a list of tokens is the encoding of its text exactly when every two
neighbours are the encoding of their own joined bytes. So the encoding of each prefix ends in one
token only, the one that fits the last token of the shorter prefix before it, and its count is one
more than there. The table holds that count for every prefix of a piece of text; pieces add up.

A short piece is looked up among those that the worker process has met. A long one (a blob of
base64, minified code) is read once from left to right, and only the prefixes that the longest
token spans are held, so memory does not grow with a word. Long texts are read in fragments.

Nulls count as the empty text (no tokens); repeated rows are counted each; further columns are
ignored by `token_counts` and kept by `truncate_to_budget`; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import tokens
from tidemark.llm.common import small_slices, table

#: Prefixes and pairs of tokens that a worker process stores, then it starts anew; bytes of a piece whose prefixes are stored.
STORED, SHORT = 500_000, 48
# Fixed values of the vocabulary: the pattern that splits a text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixTable:
    """Exact counts of byte-level tokens at every prefix of a text."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in tokens.letters_of_bytes().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.token = {v: k for k, v in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks, self.split, self.space = set(special), regex.compile(SPLIT), regex.compile(r"\s+")
        self.finder = ahocorasick.Automaton()  # which tokens end at each byte
        for token, t in self.ids.items():
            if token.decode("latin-1"):
                self.finder.add_word(token.decode("latin-1"), (len(token), t))
        self.finder.make_automaton()
        self.states: dict[bytes, tuple[int, int]] = {b"": (-1, 0)}
        self.fits: dict[tuple, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fit(self, a: int, b: int) -> bool:
        if (a, b) not in self.fits:
            if len(self.fits) > STORED:
                self.fits.clear()
            x, y = self.token[a], self.token[b]
            self.fits[a, b] = self.merged(x + y) == [x, y]
        return self.fits[a, b]

    def _alone(self, a: int) -> bool:
        if a not in self.alone:
            self.alone[a] = len(self.merged(self.token[a])) == 1
        return self.alone[a]

    def state(self, data: bytes) -> tuple[int, int]:
        """(last token, count) of data that is merged as one; those of its prefixes are stored with it if it is short."""
        if len(data) > SHORT:
            got = (-1, 0)
            for got in self.last_tokens(data):
                pass
            return got
        states = self.states
        got = states.get(data)
        if got is not None:
            return got
        if len(states) > STORED:
            states.clear()
            states[b""] = (-1, 0)
        known = len(data) - 1
        while data[:known] not in states:
            known -= 1
        ids, fits, longest = self.ids, self.fits, self.longest
        for end in range(known + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                t = ids.get(data[start:end])
                if t is None:
                    continue
                if start == 0:
                    if self._alone(t):
                        states[data[:end]] = (t, 1)
                        break
                    continue
                last, count = states[data[:start]]
                fit = fits.get((last, t))
                if self._fit(last, t) if fit is None else fit:
                    states[data[:end]] = (t, count + 1)
                    break
        return states[data]

    def last_tokens(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(last token, count) of each prefix of data, which is merged as one, but for the empty one."""
        size = self.longest + 1  # a prefix needs only the ones that a token reaches back to
        last, count = [-1] * size, [0] * size
        fits, done = self.fits, 0
        for at, (n, t) in self.finder.iter(data.decode("latin-1")):
            end = at + 1
            if end == done:
                continue
            start = end - n
            if start:
                before = last[start % size]
                fit = fits.get((before, t))
                if not (self._fit(before, t) if fit is None else fit):
                    continue
            elif not self._alone(t):
                continue
            last[end % size], count[end % size], done = t, count[start % size] + 1 if start else 1, end
            yield t, count[end % size]

    def units(self, text: str) -> Iterator[str]:
        """What is merged as one: special tokens, and the matches of SPLIT between them."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from (u.group() for u in self.split.finditer(text[at : m.start()]))
            yield m.group()
            at = m.end()
        yield from (u.group() for u in self.split.finditer(text[at:]))

    def count(self, text: str) -> int:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):  # one unit
            return self.state(text.encode())[1]
        return sum(1 if u in self.marks else self.state(u.encode())[1] for u in self.units(text))

    def count_pieces(self, pieces: list[str]) -> list[int]:
        return [self.count(w if w[0] == "\n" else " " + w) for w in pieces]

    def prefixes(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[:i], for every i from 0 to its length; each unit is read once."""
        counts, before = array("i", [0]), 0
        begin = base = 0  # the last unit that a cut special token can change, and the tokens before it
        for unit in self.units(text):
            at = len(counts) - 1
            if unit in self.marks:  # a cut special token is ordinary text, split together with that unit
                counts.extend(base + self.count(text[begin : at + i]) for i in range(1, len(unit)))
                before += 1
                begin, base = at + len(unit), before
                counts.append(before)
                continue
            begin, base = at, before
            data = unit.encode()
            if unit[0] == "'" and unit[1:].isalpha():  # a cut contraction is split in another way
                counts.extend(before + self.count(unit[:i]) for i in range(1, len(unit)))
                before += self.state(data)[1]
                counts.append(before)
            else:
                counts.extend(before + c for c in self._by_character(unit, data))
                before = counts[-1]
        for run in self.space.finditer(text):  # a cut run of white space is one unit, whatever followed it
            start = run.start()
            for i, c in enumerate(self._by_character(run.group(), run.group().encode()), start + 1):
                counts[i] = counts[start] + c
        return np.frombuffer(counts, np.int32)

    def _by_character(self, unit: str, data: bytes) -> Iterator[int]:
        """Counts of the prefixes of a unit that end with a whole character."""
        counts = (c for _, c in self.last_tokens(data))
        if len(unit) == len(data):
            yield from counts
            return
        for c in unit:
            for _ in c.encode():
                n = next(counts)
            yield n


_tables: dict[str, tuple] = {}


def prefix_table(path: str) -> tuple[PrefixTable, tokens.Pieces]:
    """The table and the remembered counts of pieces, one for each worker process."""
    if path not in _tables:
        made = PrefixTable(path)
        _tables[path] = made, tokens.Pieces(made.count, made.count_pieces, sum)
    return _tables[path]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    path = tokens.tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = prefix_table(path)
        for b in small_slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = pieces.of(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and prefix_tokens: at place i the token count of the first i characters."""
    path = tokens.tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = prefix_table(path)
        for b in small_slices(batches, 16):
            counts = [made.prefixes(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, prefix_tokens array<int>")


def truncate_to_budget(docs: DataFrame, budget: int, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """docs with text cut to its longest prefix of at most budget tokens (null stays null)."""
    path = tokens.tokenizer_path(tokenizer)
    place = docs.columns.index("text")

    def cut(text: str | None) -> str | None:
        if text is None:
            return None
        made, _ = prefix_table(path)
        return text[: int(np.flatnonzero(made.prefixes(text) <= budget)[-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, 64):
            yield b.set_column(place, "text", pa.array(map(cut, b.column("text").to_pylist()), b.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
