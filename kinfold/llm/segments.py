"""Byte-level BPE of whole texts by way of segments that encode independently of what stands beside them.

A segment is a run of white space and the run of other characters after it. The pre-tokenizer's pattern never joins
characters over the end of such a run, so the ids of a text are its segments' ids in order. Words repeat far more than
texts do, so each task encodes a distinct segment once and keeps its rendered ids in a table of bounded size.
"""

from __future__ import annotations

import functools
import operator
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

SPACE = "\t-\r \x85\xa0  -     　"
_pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_double = re.compile(r"\s\s")
#: Rendered segments that a task keeps, and the longest segment that it keeps.
KEPT, LONGEST = 200_000, 64
#: What may end a segment as a word of its own, after a letter, and what all Latin letters come before.
MARKS, LATIN = ".,;:!?%&$#*", "\u0250"


def segments(text: str) -> list[str]:
    """The independent segments; joined they give the text."""
    return _pieces.findall(text)


class _Table(dict):
    """Renderings by segment, of bounded size: when KEPT are there, they make room, but those that are asked for again while the next
    KEPT come are taken over. A segment that is in neither is rendered and, if short, kept."""

    def __init__(self, render: Callable[[str], object]):
        super().__init__()
        self.render, self.before = render, {}

    def __missing__(self, segment: str):
        got = self.before.get(segment)
        if got is None:
            got = self.render(segment)
        if len(segment) <= LONGEST:
            if len(self) >= KEPT:
                self.before = self.copy()
                self.clear()
            self[segment] = got
        return got


class SegmentEncoder:
    """Renders texts. word renders one word of Latin letters, with or without a space before it, text any string as it would be
    inside a text. special: strings that are matched before words are split. join makes one rendering of two, whole one of all of
    a text's. A segment of letters and then punctuation marks is two words, and a line feed before letters is one, so their parts
    are rendered apart: there are far fewer stems than segments.
    """

    def __init__(self, word: Callable[[str], object], text: Callable[[str], object], special: Iterable[str] = (), join: Callable = operator.add, whole: Callable = list):
        self.word, self.text, self.join, self.whole = word, text, join, whole
        self.special = [s for s in special if s]
        self.size = 0  # ids, where known
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spaced = _Table(self._after_space)  # by what follows one space; a segment that begins with a line feed stands for itself
        self.bare = _Table(self._alone)

    def _after_space(self, s: str):
        if s[:1] == "\n":
            return self.join(self.bare["\n"], self.bare[s[1:]]) if s[1:2].isalpha() else self.text(s)
        return self._rendered(s, " ", self.spaced)

    def _alone(self, s: str):
        return self._rendered(s, "", self.bare)

    def _rendered(self, s: str, before: str, table: _Table):
        if s.isalpha() and max(s) < LATIN:
            return self.word(before + s)
        stem = s.rstrip(MARKS)
        if stem and len(stem) < len(s) and stem[-1].isalpha() and stem[-1] < LATIN:
            return self.join(table[stem], self.bare[s[len(stem) :]])
        return self.text(before + s)

    def _of(self, text: str) -> Iterable:
        if _double.search(text):
            return map(self.bare.__getitem__, segments(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        got = map(self.spaced.__getitem__, rest)
        return chain((self.bare[first],), got) if first else got

    def render(self, texts: list[str]) -> list:
        """For each text what whole makes of the renderings of its segments, in order."""
        out = []
        for text in texts:
            if self.split and any(s in text for s in self.special):
                parts = [(self.text(p),) if k % 2 else self._of(p) for k, p in enumerate(self.split.split(text)) if p]
                out.append(self.whole(chain.from_iterable(parts)))
            else:
                out.append(self.whole(self._of(text)))
        return out


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, other bytes from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


@functools.cache
def library_encoder(path: str) -> SegmentEncoder:
    """Renders ids as little-endian unsigned 32-bit integers, by the tokenizers library. A single word of Latin letters goes to
    its model at once, all else through its whole pipeline. One a process: a worker's next task finds its table filled."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    tokenize, stand_in = t.model.tokenize, {b: c for c, b in byte_symbols().items()}

    def packed(ids: list[int]) -> bytes:
        ids = array("I", ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def word(w: str) -> bytes:
        return packed([x.id for x in tokenize(w.encode().decode("latin-1").translate(stand_in))])

    def text(w: str) -> bytes:
        return packed(t.encode(w, add_special_tokens=False).ids)

    encoder = SegmentEncoder(word, text, [a.content for a in t.get_added_tokens_decoder().values()], whole=b"".join)
    encoder.size = t.get_vocab_size(with_added_tokens=True)
    return encoder


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
