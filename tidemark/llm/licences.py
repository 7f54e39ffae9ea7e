"""License scans: notice phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser.

A text is lower-cased (A-Z) and cut into words; one automaton over the words finds all notice phrases
and the words of identifier tags in one walk, which goes on from part to part of a long text. Where a
tag's words occur, a second automaton finds the tags as written ("SPDX-License-Identifier:", "License:"),
and what follows on the line is read as an expression of identifiers, `and`, `or`, `with` and brackets.
The shunting-yard parser puts it in postfix order and evaluates it: `and` holds both sides, `or` leaves
the choice, `with` grants an exception. Only the longest part that is an expression counts, so prose after
it is no licence, and a tag that no known identifier follows says nothing.

A document's labels are those of its phrases and of the identifiers of its expressions; `score` is how
restrictive the strictest of its statements is (0 where it has none), `expressions` the normal forms.

A null or empty text has no words, no places, empty labels and score 0. Repeated and null ids are rows as
others are; ties do not occur; other columns are ignored; an empty table gives an empty one. A word is
never cut, however long it is, and an expression may be as long and as deep as its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_slices, table, word_parts

# The base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further phrases of notices with their labels.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "boost software license": "bsl", "dedicated to the public domain": "cc0",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "creative commons attribution": "cc-by", "free and unencumbered software": "unlicense",
    "no part of this publication may be reproduced": "reserved",
}
# Labels with how restrictive they are: permissive, weak and strong copyleft, limits on use, all rights kept.
RESTRICTS = {
    "0bsd": 0.05, "cc0": 0.05, "unlicense": 0.05, "wtfpl": 0.05, "mit": 0.1, "isc": 0.1, "zlib": 0.1, "bsd": 0.15, "bsl": 0.15, "apache": 0.2, "artistic": 0.3, "cc-by": 0.3,
    "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "lgpl": 0.6, "cc-by-sa": 0.7, "gpl": 0.8, "cc-by-nd": 0.85, "cc-by-nc": 0.9, "agpl": 0.9, "licenseref": 0.95, "reserved": 1.0,
}
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
TAG_WORDS = ("spdx license identifier", "license", "licence")
RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()/]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_QUOTES = " \t\"'`"


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier: that of its longest beginning that is known."""
    parts = identifier.lower().rstrip("+").split("-")
    for k in range(min(3, len(parts)), 0, -1):
        name = "-".join(parts[:k])
        if name in RESTRICTS and name != "reserved":
            return name
    return None


def tokens_of(line: str) -> list[str]:
    """The tokens of the longest beginning of a line that is a whole expression."""
    out: list[str] = []
    depth = whole = at = 0
    operand = exception = False  # whether an operand ended last; whether an exception's name must follow
    while m := _TOKEN.match(line, at):
        token, at = m.group(1), m.end()
        word = "or" if token == "/" else token.lower()
        if not operand:
            if token == "(" and not exception:
                depth += 1
            elif exception and word not in RANK and token not in "()/":
                operand, exception = True, False
            elif not exception and label_of(token.rstrip(".:")):
                operand = True
                stop = token[-1] in ".:"
                token = token.rstrip(".:")
                if stop:
                    at = len(line)
            else:
                break
        elif token == ")" and depth:
            depth -= 1
        elif word in RANK and not (word == "with" and out[-1] == ")"):
            token, operand, exception = word, False, word == "with"
        else:
            break
        out.append(token)
        if operand and not depth:
            whole = len(out)
    return out[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands in order, operators by rank, all from the left."""
    out, held = [], []
    for token in tokens:
        if token in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[token]:
                out.append(held.pop())
            held.append(token)
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(expression: str) -> tuple[str, set[str], float] | None:
    """(normal form, labels, restrictiveness) of the expression that the text begins with, or None."""
    tokens = tokens_of(expression)
    if not tokens:
        return None
    labels: set[str] = set()
    values: list[tuple[list[str], int, float]] = []  # parts of the normal form, its rank, how restrictive
    exception = False
    for k, token in enumerate(ordered := postfix(tokens)):
        if token in RANK:
            (right, right_rank, y), (left, left_rank, x) = values.pop(), values.pop()
            left = ["(", *left, ")"] if left_rank < RANK[token] else left
            right = ["(", *right, ")"] if right_rank < RANK[token] else right
            # an exception halves what the licence asks for
            values.append(([*left, f" {token} ", *right], RANK[token], max(x, y) if token == "and" else min(x, y) if token == "or" else x / 2))
        else:
            exception = k + 1 < len(ordered) and ordered[k + 1] == "with"
            label = None if exception else label_of(token)
            labels |= {label} if label else set()
            values.append(([token.lower()], 4, RESTRICTS[label] if label else 0.0))
    parts, _, restricts = values.pop()
    return "".join(parts), labels, restricts


class Scanner:
    """The automata, built once for each worker process."""

    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        named = [(p, label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in NOTICES.items()] + [(p, None, False) for p in TAG_WORDS]
        for phrase, label, base in named:
            self.phrases.add_word(f" {phrase} ", (label, base, len(phrase.split())))
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def places(self, text: bytes) -> Iterator[tuple[str | None, bool, int]]:
        """(label, base, first word) of every phrase; label None for a tag's words. The last item tells the number of words."""
        walk, words, before = None, 0, 0
        for part in word_parts(text):
            if not part:
                continue
            shown = b" ".join(part).decode("utf-8", "replace") + " "
            if walk is None:
                shown = " " + shown
                walk, seen = self.phrases.iter(shown), -2
            else:
                walk.set(shown, False)
                seen = words - 1
            at = 0
            for end, (label, base, size) in walk:
                here = end - before + 1
                seen += shown.count(" ", at, here)
                at = here
                yield label, base, seen - size + 1
            words, before = words + len(part), before + len(shown)
        yield None, True, words

    def expressions(self, text: str) -> Iterator[tuple[str, set[str], float]]:
        """The evaluated expression after every tag."""
        low = text.translate(_SMALL)
        for end, size in self.tags.iter(low):
            begin = end + 1 - size
            if begin and low[begin - 1].isalnum() or (begin and low[begin - 1] == "-"):
                continue
            line_end = low.find("\n", end)
            line = text[end + 1 : line_end if line_end >= 0 else len(text)].lstrip(_QUOTES)
            if found := evaluate(line):
                yield found

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
        n_base, first, last, base_labels, labels, score, tag, forms, words = 0, None, None, set(), set(), 0.0, False, set(), 0
        for label, base, at in self.places(text or b""):
            if label is None:
                tag, words = tag or not base, at if base else words
                continue
            labels.add(label)
            score = max(score, RESTRICTS[label])
            if base:
                n_base += 1
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
                base_labels.add(label)
        if tag:
            for form, names, restricts in self.expressions(text.decode("utf-8", "replace")):
                forms.add(form)
                labels |= names
                score = max(score, restricts)
        return words, n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, "; ".join(sorted(forms))


_SMALL = {a: a + 32 for a in range(65, 91)}
_scanners: list[Scanner] = []
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())


def licences(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, as SCHEMA says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanners:
            _scanners.append(Scanner())
        for b in small_slices(batches):
            rows = [_scanners[0].scan(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
