"""Byte-level BPE through an automaton compiled from the merges, one gadget a merge.

The automaton reads tokens. At first one state has an arc for every byte. The gadget of merge (u, v) -> w copies the state that
u's arcs lead to, without its arc for v, and sends u's arcs to the copy; every state with an arc for u gets an arc for w, to
where v's arc led. What remains are exactly the sequences that BPE leaves unmerged. All arcs of a token end in one state, so in
the end there is one state a token beside the first, and it is known which arcs each state has lost: those of gadget (x, y) are
lost between every token that ends in x, through merges behind the gadget's, and every token that begins with y in that way.

Both sets are intervals: tokens are numbered in the preorder of the tree in which a token hangs below its right part, latest
children first, and in that of the left parts. A gadget is thus a rectangle of lost arcs. All rectangles are compiled into one
table of disjoint intervals, sorted by state and token, and an arc is a binary search in its state's part of the table.

A word is read from its first byte on: the longest token whose arc the state has is taken, the state becomes the token's, and
where no arc leads on, the last one is taken back; as each word has one path, what has failed once is never tried again. Decoding
emits the arcs' labels. Nulls count as empty texts; repeated rows and equal texts give equal values, row by row. A text of any
length is rendered in one piece, a few times its bytes. Other columns are not read, so they may have any names. An empty table
gives no rows; an unknown id raises an error.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, segments

COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _preorder(size: int, parent: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens (0 to size - 1; parents are made before their children) in preorder, latest children first, and the sizes of
    their subtrees; beside them the tokens with parents by parent, latest first, and the place behind each one's subtree."""
    weight = np.ones(size, np.int64)
    some = np.flatnonzero(parent >= 0)
    for t in some[np.argsort(-made[some], kind="stable")].tolist():  # children before parents
        weight[parent[t]] += weight[t]
    by = some[np.lexsort((-made[some], parent[some]))]
    ends = np.cumsum(weight[by])
    first = np.searchsorted(parent[by], parent[by])
    behind = ends - (ends - weight[by])[first]  # of the subtree, from the parent's first child on
    place = np.zeros(size, np.int64)
    roots = np.flatnonzero(parent < 0)
    place[roots] = np.cumsum(weight[roots]) - weight[roots]
    offset = np.zeros(size, np.int64)
    offset[by] = behind - weight[by]
    for t in some[np.argsort(made[some], kind="stable")].tolist():  # parents before children
        place[t] = place[parent[t]] + 1 + offset[t]
    return place, weight, by, behind


def _reach(tokens: np.ndarray, times: np.ndarray, parent: np.ndarray, made: np.ndarray, order: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The interval of places of each token itself and what hangs below it through children made after its time."""
    place, _, by, behind = order
    span = np.int64(len(made) + 2)
    # children lie by parent and falling time: count those of the parent with a later time
    keys = parent[by] * span + (span - 2 - made[by])
    n = np.searchsorted(keys, tokens * span + (span - 2 - times))
    none = n == np.searchsorted(keys, tokens * span)
    reach = np.where(none, 0, behind[np.maximum(n - 1, 0)] if len(behind) else 0)
    return place[tokens], place[tokens] + 1 + reach


#: In place of a token: none is left to try.
_NONE = (None,) * 5


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        symbols = segments.byte_symbols()
        self.special = special or {}
        self.labels = {i: bytes(symbols[c] for c in s) for s, i in vocabulary.items() if s not in self.special}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        letters = [i for s, i in vocabulary.items() if s not in self.special and len(s) == 1]
        number = {i: k for k, i in enumerate(letters)}  # tokens by the order in which they are made
        left, right = [-1] * len(number), [-1] * len(number)
        gadgets: dict[tuple[int, int], int] = {}
        for a, b in merges:
            u, v, w = (vocabulary[x] for x in (a, b, a + b))
            if w in number:
                raise ValueError(f"{a + b} is made by two merges")
            if u not in number or v not in number or self.lost(number[u], number[v], left, right, len(letters), gadgets):
                continue  # u is never followed by v: the merge can't occur
            gadgets[number[u], number[v]] = len(gadgets)
            number[w] = len(left)
            left.append(number[u])
            right.append(number[v])
        self.compile(len(letters), np.array(left, np.int64), np.array(right, np.int64), list(gadgets))
        #: By a token's bytes: its id, its state, its place among the arcs, its length and the next shorter token that it begins
        #: with. By four first bytes: the longest token's length.
        self.tokens: dict[bytes, tuple] = {}
        self.longest: dict[bytes, int] = {}
        for label, i, k in sorted((self.labels[i], i, k) for i, k in number.items()):
            begin = next((t for n in range(len(label) - 1, 0, -1) if (t := self.tokens.get(label[:n]))), None)
            self.tokens[label] = i, int(self.state[k]), int(self.arc[k]), len(label), begin
            self.longest[label[:4]] = max(len(label), self.longest.get(label[:4], 0))

    def compile(self, letters: int, left: np.ndarray, right: np.ndarray, gadgets: list[tuple[int, int]]) -> None:
        """Fill the table: bounds, where intervals of lost arcs begin and end, those of state k from rows[k] to rows[k + 1]."""
        size = len(left)
        made = np.maximum(np.arange(size) - letters, -1)
        by_right, by_left = _preorder(size, right, made), _preorder(size, left, made)
        self.state, self.arc = by_right[0], by_left[0]
        pairs = np.array(gadgets, np.int64).reshape(-1, 2)
        times = np.arange(len(pairs))
        top, bottom = _reach(pairs[:, 0], times, right, made, by_right)
        low, high = _reach(pairs[:, 1], times - 1, left, made, by_left)  # of u and u, the token made has lost u's arc at once
        rows = np.repeat(top - np.concatenate([[0], np.cumsum(bottom - top)[:-1]]) if len(top) else top, bottom - top) + np.arange(int((bottom - top).sum()))
        width = size + 1  # so that intervals of two states never touch
        begin, end = rows * width + np.repeat(low, bottom - top), rows * width + np.repeat(high, bottom - top)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        fresh = np.ones(len(begin), bool)
        fresh[1:] = begin[1:] > end[:-1]
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1) if len(end) else np.zeros(0, np.int64)
        self.bounds = array("q", np.stack([begin[fresh], end[last]], 1).ravel().tobytes())
        self.rows = array("q", (2 * np.searchsorted(begin[fresh], np.arange(size + 1) * width)).astype(np.int64).tobytes())
        self.width = width

    @staticmethod
    def lost(u: int, v: int, left: list[int], right: list[int], letters: int, gadgets: dict[tuple[int, int], int]) -> bool:
        """Whether one of the gadgets so far has taken the arc for v away from u's state."""
        x, before = u, len(gadgets)
        while x >= 0:
            y, until = v, len(gadgets)
            while y >= 0:
                if (k := gadgets.get((x, y))) is not None and k < before and k <= until:
                    return True
                until, y = y - letters, left[y]
            before, x = x - letters, right[x]
        return False

    def has(self, state: int, arc: int) -> bool:
        """Whether the state has the arc; -1 is the first state, which has lost none."""
        if state < 0:
            return True
        lo = self.rows[state]
        return not (bisect_right(self.bounds, state * self.width + arc, lo, self.rows[state + 1]) - lo) & 1

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        whole = self.tokens.get(word)
        if whole is not None:  # made by merges, so nothing else is
            return [whole[0]]
        n, get, longest, bounds, rows, width = len(word), self.tokens.get, self.longest.get, self.bounds, self.rows, self.width
        at, state, out, failed = 0, -1, [], set()  # out: places, states and tokens taken
        low = high = first = 0
        token = None
        while at < n:
            if token is _NONE:
                token = None  # no shorter token either
            elif token is None:
                end = min(n, at + longest(word[at : at + 4], 3))
                while (token := get(word[at:end])) is None and end > at:
                    end -= 1
            # an odd number of bounds before the arc's place: the state has lost it
            while token is not None and (state >= 0 and bisect_right(bounds, first + token[2], low, high) - low & 1 or failed and (at + token[3], token[1]) in failed):
                token = token[4]
            if token is not None:
                out.append((at, state, token))
                at, state = at + token[3], token[1]
                token = None
            else:
                if not out:
                    raise ValueError(f"{word!r} has a byte that is no token")
                failed.add((at, state))
                at, state, token = out.pop()
                if (token := token[4]) is None:
                    token = _NONE
            low, high, first = (rows[state], rows[state + 1], state * width) if state >= 0 else (0, 0, 0)
        return [x[2][0] for x in out]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


_automata: dict[str, tuple] = {}


def load(path: str) -> tuple[Automaton, object]:
    """The automaton of a tokenizers file and its compiled word pattern; one per process and path."""
    if path not in _automata:
        import regex
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        _automata[path] = Automaton(spec["model"]["vocab"] | special, merges, special), regex.compile(PATTERN)
    return _automata[path]


@functools.cache
def encoder(path: str) -> segments.SegmentEncoder:
    """Renders a segment as (decimal ids joined by commas, bytes that decoding emits)."""
    automaton, pattern = load(path)

    decimal = {i: str(i).encode() for i in automaton.labels}

    def rendered(ids: list[int]) -> tuple[bytes, bytes]:
        return b",".join([decimal[i] for i in ids]), automaton.decode(ids)

    def word(w: str) -> tuple[bytes, bytes]:
        return rendered(automaton.encode(w.encode()))

    def text(s: str) -> tuple[bytes, bytes]:
        return rendered([automaton.special[s]] if s in automaton.special else [i for w in pattern.findall(s) for i in automaton.encode(w.encode())])

    return segments.SegmentEncoder(word, text, automaton.special, lambda a, b: (a[0] + b"," + b[0], a[1] + b[1]))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: its number of ids and digests of the ids and of the text decoded from them."""
    common.prepare(docs.sparkSession)
    tokenizer = tokenizer or segments.default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = encoder(tokenizer).render
        for b in batches:
            n, ids, texts = [], [], []
            for got in render(b.column(1).to_pylist()):
                joined = b",".join([x[0] for x in got])
                n.append(joined.count(b",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined).hexdigest())
                texts.append(hashlib.sha256(b"".join([x[1] for x in got]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", common.text_of().alias("text")).mapInArrow(task, COLUMNS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
