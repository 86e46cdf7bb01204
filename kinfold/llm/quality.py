"""Quality classifier from weak labels.

Overlapping heuristic labelers vote on each document: good, bad or nothing. Their votes are counted by pattern, of which there are
few however many documents there are. Expectation-maximisation over the counts estimates how each labeler votes on good and on
bad documents, and so a posterior for each pattern. The posteriors label a sample of at most SAMPLE different texts, those of least
hash, on which a linear scorer over hashed features (shapes of words and the words themselves, as shares of a document's words) is
trained by logistic regression. The scorer then judges every whole document; one whose score is below zero is rejected.

Each labeler measures something of its own, and each fault shows in two of them at least. The sample is drawn from the texts that
there are, however often each is repeated, so it is never empty while there is a document.

Nulls: a null text is empty; a document without words is rejected with score -inf. A null doc_id is kept and judged. Repeated
rows are judged alike; a score of exactly zero keeps. A text of any length is judged as a whole, in a few times its bytes. An
empty table gives no rows. Other columns pass through, but for those that have the names of added ones, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import Words, mixed

#: Texts that the scorer is trained on at most, how many features they have together at most, and bits of the feature hash.
SAMPLE, CELLS, BITS = 4_000, 4_000_000, 14
LABELERS = ("symbols", "letters", "shouting", "endings", "lone", "echo", "variety", "sentences")
#: Bounds of a labeler's votes: bad on good documents, good on bad ones.
FALSE, BLIND = 0.003, 0.5
SYMBOLS, MARKS = b"#$%&*~^<>{}[]\\|!", b".,;:?'\"()-"

_class = np.full(256, 4, np.uint8)
_class[list(range(97, 123)) + list(range(128, 256))] = 0
_class[65:91] = 1
_class[48:58] = 2
_class[list(MARKS)] = 3
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


class Documents:
    """Counts per document of one Arrow column, and each word's two features."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column)
        self.hash, data = w.hashes(), w.data
        self.echo = np.zeros(len(self.hash), bool)
        self.echo[1:] = (self.hash[1:] == self.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        kinds = _class[data]
        if len(data):
            first, last, before = (kinds[k].astype(np.int64) for k in (w.start, w.end - 1, np.maximum(w.end - 2, w.start)))
        else:
            first = last = before = np.zeros(0, np.int64)
        size = np.minimum(w.end - w.start, 3) - 1
        shape = ((((first * 5 + last) * 5 + before) * 3 + size) * 2 + self.echo).astype(np.uint64)
        mask = np.uint64((1 << BITS) - 1)
        self.features = (mixed(shape + np.uint64(1)) & mask).astype(np.int64), (self.hash & mask).astype(np.int64)
        self.last, self.before = last, before

    def per(self, mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.words.offsets[1:]] - sums[self.words.offsets[:-1]]

    def patterns(self) -> np.ndarray:
        """The votes of all labelers as one number in base 3: 0 bad, 1 none, 2 good."""
        w, data = self.words, self.words.data
        n = np.maximum(w.counts, 1)
        kinds = _class[data]

        def share(of: np.ndarray) -> np.ndarray:
            """Of a document's words."""
            return np.bincount(w.doc, of, minlength=len(n)) / n

        symbols = self.per(_symbol[data]) / n
        upper, lower = self.per(kinds == 1), self.per(kinds == 0)
        letters, solid = upper + lower, np.bincount(w.doc, w.end - w.start, minlength=len(n))
        plain, loud = self.per(kinds <= 2) / np.maximum(solid, 1), upper / np.maximum(letters, 1)
        spoken = np.concatenate([np.zeros(1, np.int32), np.cumsum(kinds <= 2, dtype=np.int32 if len(kinds) < 1 << 31 else np.int64)])
        lone = share(spoken[w.end] == spoken[w.start])
        doubled = share((self.last >= 3) & (self.before >= 3) & (w.end - w.start > 1))
        ends = share((self.last == 3) & (self.before <= 2))
        again = share(self.echo)
        one = np.unique(mixed(self.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]  # of each word of a document
        variety = np.bincount(w.doc[one], minlength=len(n)) / n
        few, some = w.counts < 4, w.counts >= 30

        def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            return np.where(bad, 0, np.where(good, 2, 1))

        votes = (
            vote(symbols > 0.25, symbols < 0.05),
            vote((plain < 0.8) & ~few, (plain > 0.9) | few),
            vote((loud > 0.3) & ~few, (loud < 0.15) | few),
            vote(doubled > 0.25, doubled < 0.08),
            vote(lone > 0.1, lone < 0.03),
            vote((again > 0.15) & ~few, again < 0.05),
            vote(some & (variety < 0.15), some & (variety > 0.3)),
            vote((w.counts >= 50) & (ends < 0.005), ends > 0.02),
        )
        out = np.zeros(len(n), np.int64)
        for v in votes:
            out = out * 3 + v
        return out

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        w = self.words
        sums = np.bincount(w.doc, weights[self.features[0]] + weights[self.features[1]], minlength=len(w.counts))
        return np.where(w.counts > 0, bias + sums / np.maximum(w.counts, 1), -np.inf)


def _votes(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def limited(chances: list[float], vote: int, bound: float, pick: Callable) -> list[float]:
    """The chances with that of one vote held to a bound and the others in proportion."""
    kept = pick(chances[vote], bound)
    rest = (1 - kept) / max(1 - chances[vote], 1e-12)
    return [kept if v == vote else max(c * rest, 1e-9) for v, c in enumerate(chances)]


def estimate(counts: dict[int, int], rounds: int = 60, false: float = FALSE, blind: float = BLIND) -> tuple[dict[int, float], dict[str, tuple[list[float], list[float]]]]:
    """(posterior of good by pattern, per labeler its votes' chances on good and on bad documents), by
    expectation-maximisation with pseudo-counts, from a start where labelers are right more often than not. Labelers see a fault
    each, so the estimates are held to what that means: a labeler calls at most false of the good documents bad, and at least blind
    of the bad ones, those with other faults, good. Without these bounds the commonest fault alone becomes the bad class."""
    start = ([0.02, 0.28, 0.7], [0.35, 0.3, 0.35])  # a bad document may well have but one fault
    good, bad, prior, posterior = [list(start[0]) for _ in LABELERS], [list(start[1]) for _ in LABELERS], 0.7, {}
    total = sum(counts.values())
    votes = {p: _votes(p) for p in counts}
    for _ in range(rounds):
        for p, vs in votes.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[k][v] / bad[k][v]) for k, v in enumerate(vs))
            posterior[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        mass = sum(n * posterior[p] for p, n in counts.items())
        prior = (mass + 7) / (total + 10)
        for k in range(len(LABELERS)):
            sums = [[0.0] * 3, [0.0] * 3]
            for p, n in counts.items():
                sums[0][votes[p][k]] += n * posterior[p]
                sums[1][votes[p][k]] += n * (1 - posterior[p])
            good[k] = [(sums[0][v] + 10 * start[0][v]) / (mass + 10) for v in range(3)]
            bad[k] = [(sums[1][v] + 10 * start[1][v]) / (total - mass + 10) for v in range(3)]
            good[k], bad[k] = limited(good[k], 0, false, min), limited(bad[k], 2, blind, max)
    return posterior, {name: (good[k], bad[k]) for k, name in enumerate(LABELERS)}


def train(rows: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by adaptive gradient steps over the whole sample: (weights, bias)."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not len(labels):
        return weights, bias
    doc, column, value = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), np.concatenate(shares)
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for k in range(1, rounds + 1):
        z = bias + np.bincount(doc, value * weights[column], minlength=len(rows))
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
        step = np.append(np.bincount(column, value * miss[doc], minlength=len(weights)) + decay * weights / len(rows), miss.sum())
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step**2
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)
        weights -= move[:-1]
        bias -= float(move[-1])
    return weights, bias


def fit(docs: DataFrame, sample: int = SAMPLE, cells: int = CELLS) -> tuple[np.ndarray, float, dict]:
    """(weights, bias, the labelers' estimated votes). Counts all documents' patterns, trains on at most sample different texts with
    at most cells features together (one text at least), those of least hash."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.xxhash64(common.text_of()).alias("h"), common.text_of().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Documents(b.column(1)).patterns()), b.column(0)], ["pattern", "h"])
        common.trim()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's part of the sample
        for b in batches:
            h, fresh = b.column(0).to_pylist(), []
            for k, x in enumerate(h):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            b = b.take(pa.array(fresh, pa.int64()))
            d = Documents(b.column(1))
            columns, shares = [], []
            ends = np.cumsum(d.words.counts)
            for k, n in enumerate(d.words.counts):
                own = slice(ends[k] - n, ends[k])
                index, times = np.unique(np.concatenate([d.features[0][own], d.features[1][own]]), return_counts=True)
                columns.append(index)
                shares.append(times / max(1, n))
            sizes = pa.array([len(x) for x in columns], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.patterns()), sizes, pa.array(columns, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["h", "pattern", "n", "columns", "shares"])
        common.trim()

    found = rows.mapInArrow(count, "pattern long, h long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).collect()  # 3^8 rows at most
    counts = {r["pattern"]: r["n"] for r in found}
    if not counts:
        return np.zeros(1 << BITS), 0.0, {}
    posterior, learned = estimate(counts)
    # a text has one pattern, so the patterns' numbers of texts add up
    share = min(1.0, 2 * sample / sum(r["texts"] for r in found))
    place = F.pmod("h", F.lit(1 << 30))
    some = rows.filter(place < F.lit(math.ceil(share * (1 << 30)))).mapInArrow(describe, "h long, pattern long, n long, columns array<int>, shares array<float>")
    table, path = common.cut(some, "sample")
    sizes = table.groupBy(place.alias("place"), "h").agg(F.max("n").alias("n")).orderBy("place", "h").limit(sample).collect()
    held = np.cumsum([r["n"] for r in sizes])
    last = sizes[max(0, int(np.searchsorted(held, cells, "right")) - 1)]
    chosen = table.filter((place < last["place"]) | (place == last["place"]) & (F.col("h") <= last["h"])).dropDuplicates(["h"])
    got = chosen.orderBy("h").select("pattern", "columns", "shares").toArrow()
    common.remove(docs.sparkSession, path)
    labels = np.array([posterior[p] for p in got.column("pattern").to_pylist()])
    weights, bias = train([x.values.to_numpy().astype(np.int64) for x in got.column("columns")], [x.values.to_numpy().astype(float) for x in got.column("shares")], labels)
    return weights, bias, learned


def judged(docs: DataFrame, model: tuple | None = None, added: tuple[str, str] = ("score", "keep")) -> DataFrame:
    """docs with score and keep, or other names for them, added; columns of those names are replaced."""
    weights, bias, _ = model or fit(docs)
    common.prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in added]
    place = names.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = Documents(b.column(place)).scores(weights, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array(score >= 0)], [*names, *added])
        common.trim()

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.BooleanType())])
    return docs.select(names).mapInArrow(task, schema)


def kept(docs: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they were."""
    return judged(docs, added=("_score", "_keep")).filter("_keep").select(docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.round("score", 6).alias("score"), F.col("keep").cast("int").alias("keep"))
