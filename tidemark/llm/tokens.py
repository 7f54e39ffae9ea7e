"""Exact token ids of whole texts by the public tokenizer files, with the words of a task remembered.

Both vocabularies split a text before they merge, and never across a blank or a line break that
stands between other characters. So a text is cut there and each distinct piece is encoded by the
library once for a task; the ids of a text are the joined ids of its pieces.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: Pieces that a worker process remembers, then it starts anew; and how long such a piece is at most.
REMEMBERED, SHORT = 600_000, 64
#: Characters of a text that are cut into pieces at once.
CHARS_AT_ONCE = 1 << 20
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]")
_loaded: dict[tuple, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer with its defaults, one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if ("library", path) not in _loaded:
        from tokenizers import Tokenizer

        _loaded["library", path] = Tokenizer.from_file(path)
    return _loaded["library", path]


def _irregular(text: str) -> bool:
    """Whether it has white space other than single blanks and single line breaks between words."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
        return True
    return _other_space(text)


def _other_space(text: str) -> bool:
    return (not text.isascii() or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")) and _ODD.search(text) is not None


def fragments(text: str) -> Iterator[str]:
    """A long text in parts, cut before a blank or line break that stands between other characters."""
    begin = 0
    while len(text) - begin > CHARS_AT_ONCE:
        m = _CUT.search(text, begin + CHARS_AT_ONCE)
        if not m:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def _forget(known: dict, new: list[str]) -> None:
    """Leaves out pieces too long to be remembered, and all of them once they are too many."""
    if len(known) > REMEMBERED:
        known.clear()
    for w in new:
        if len(w) > SHORT:
            known.pop(w, None)


class Pieces:
    """Values of the pieces of texts. A piece starts with the blank or line break before it.

    one(text) gives the value of any text; many(pieces) those of distinct regular pieces, of which
    a leading blank is left out and a leading line break is not. No value is None. join(values) is
    the value of a whole, also of joined wholes.
    """

    def __init__(self, one, many, join):
        self.one, self.many, self.join = one, many, join
        self.known: dict = {}
        self.alone: dict = {}

    def _alone(self, text: str):
        got = self.alone.get(text)
        if got is None:
            got = self.one(text)
            if len(text) <= SHORT:
                if len(self.alone) >= REMEMBERED:
                    self.alone.clear()
                self.alone[text] = got
        return got

    def _runs(self, text: str) -> list:
        # A cut inside other white space (tabs, no-break blanks) would change how it is split.
        return [self.one(text)] if _other_space(text) else [self._alone(m.group()) for m in _RUNS.finditer(text)]

    def _values(self, texts: list[str], inner: bool = False) -> list:
        """The values of texts; inner: they begin with a blank or line break after other characters."""
        cut = [None if not t or _irregular(t[1:] if inner else t) else t.replace("\n", " \n").split(" ") for t in texts]
        first = [None if p is None else p.pop(0) for p in cut]
        new = list(set().union(*filter(None, cut)).difference(self.known))
        self.known.update(zip(new, self.many(new), strict=True))
        get = self.known.__getitem__
        out = []
        for t, p, w in zip(texts, cut, first, strict=True):
            values = () if not t else self._runs(t) if p is None else map(get, p) if inner else [self._alone(w), *map(get, p)]
            out.append(self.join(list(values)))
        _forget(self.known, new)
        return out

    def of(self, texts: list[str]) -> list:
        """The value of each text; a long one is read in fragments."""
        if max(map(len, texts), default=0) <= CHARS_AT_ONCE:
            return self._values(texts)
        out = []
        for t in texts:
            parts = fragments(t)
            out.append(self.join([self._values([next(parts)])[0], *(self._values([f], True)[0] for f in parts)]))
        return out


def _split_at(ids: list[int], mark: int, n: int) -> list[bytes]:
    """The ids after each of the n marks."""
    if not n:
        return []
    ids = np.asarray(ids, "<u4")
    at = np.flatnonzero(ids == mark)
    if len(at) != n:
        raise ValueError("a separator was merged")
    data = ids.tobytes()
    ends = (np.append(at[1:], len(ids)) * 4).tolist()
    return [data[a:b] for a, b in zip((at * 4 + 4).tolist(), ends, strict=True)]


def letters_of_bytes() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _merge(library, letters: dict[int, str]):
    """Ids of text that the library merges as one, by its model alone: no splitting, no offsets."""
    tokenize, blank = library.model.tokenize, letters[32]
    packed = [struct.Struct(f"<{n}I").pack for n in range(SHORT)]

    def ids(text: str) -> bytes:
        if text.isascii() and text.lstrip(" ").isalpha():  # ASCII letters stand for themselves
            shown = text.replace(" ", blank)
        else:
            shown = text.encode().decode("latin-1").translate(letters)
        found = [t.id for t in tokenize(shown)]
        return packed[len(found)](*found) if len(found) < SHORT else np.array(found, "<u4").tobytes()

    return ids


def byte_level_ids(path: str):
    """texts -> little-endian uint32 ids of each as bytes, by the byte-level vocabulary."""
    if ("byte", path) in _loaded:
        return _loaded["byte", path]
    library = load(path)
    one = lambda s: np.asarray(library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    line_break = one("\n")
    mark = int(np.frombuffer(line_break, "<u4")[0])

    merge = _merge(library, letters_of_bytes())
    signs = {c: one(c) for c in ".,"}

    def many(pieces: list[str]) -> list[bytes]:
        got: dict[str, bytes] = {}
        rest = []
        for w in pieces:
            if w.isalpha():  # one unit, with its blank
                got[w] = merge(" " + w)
            elif w[-1] in ".," and w[:-1].isalpha():
                got[w] = (pieces_.known.get(w[:-1]) or merge(" " + w[:-1])) + signs[w[-1]]
            elif "<|" in w:
                got[w] = one(w if w[0] == "\n" else " " + w)
            else:
                rest.append(w)
        for at in range(0, len(rest), 200):
            some = rest[at : at + 200]
            text = "".join("\n" + w[1:] if w[0] == "\n" else "\n " + w for w in some)
            for w, ids in zip(some, _split_at(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, mark, len(some)), strict=True):
                got[w] = line_break + ids if w[0] == "\n" else ids
        return [got[w] for w in pieces]

    pieces_ = Pieces(one, many, b"".join)
    _loaded["byte", path] = pieces_.of
    return _loaded["byte", path]


def word_level_ids(path: str):
    """The same by the vocabulary with word ends, which drops white space: any cut at blanks is exact."""
    if ("word", path) in _loaded:
        return _loaded["word", path]
    library = load(path)
    one = lambda s: np.asarray(library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    sign = next(c for c in "\u00a7\u00b6\u00a4\u2603|" if len(one(c)) == 4)
    mark = int(np.frombuffer(one(sign), "<u4")[0])
    known: dict[str, bytes] = {"": b""}
    merge, signs = _merge(library, letters_of_bytes()), {c: one(c) for c in ".,"}

    def normalized(words: list[str]) -> dict[str, str]:
        """Many words at once: a blank between two of them keeps them apart."""
        lows = library.normalizer.normalize_str(" ".join(words)).split(" ") if words else []
        return dict(zip(words, lows if len(lows) == len(words) else map(library.normalizer.normalize_str, words), strict=True))

    def values(new: list[str]) -> dict[str, bytes]:
        got, plain = {}, []
        bases = {w: w[:-1] if w[-1] in ".," else w for w in new}
        lows = normalized(list({b for b in bases.values() if not b.isascii() and b.isalpha()}))
        for w, base in bases.items():
            if base.isalpha():
                low = base.lower() if base.isascii() else lows[base]
                if low.isalpha():  # one unit
                    got[w] = (known.get(base) or merge(low)) + (signs[w[-1]] if base is not w else b"")
                    continue
            if "<|" in w or sign in w or len(w) > SHORT:
                got[w] = one(w)
            else:
                plain.append(w)
        for at in range(0, len(plain), 200):
            some = plain[at : at + 200]
            text = "".join(f" {sign} {w}" for w in some)
            got.update(zip(some, _split_at(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, mark, len(some)), strict=True))
        return got

    def of(texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*cut).difference(known))
        known.update(values(new))
        out = [b"".join(map(known.__getitem__, p)) for p in cut]
        _forget(known, new)
        known[""] = b""
        return out

    def encode(texts: list[str]) -> list[bytes]:
        if max(map(len, texts), default=0) <= CHARS_AT_ONCE:
            return of(texts)
        return [b"".join(of([f])[0] for f in fragments(t)) for t in texts]

    _loaded["word", path] = encode
    return encode
