"""SimHash near-dedup at wide distances: the links are pairs of a Jaccard similarity of at least SIMILAR.

Texts that are alike by four shingles in five differ in ten of 64 fingerprint bits on average, so segments of fingerprints alone
select nothing. Candidates are pairs that share a rare shingle: under one order of all shingles, two sets whose similarity is at
least t share one among the first n - ceil(t * n) + 1 of each, n being the set's own size. This holds for every order, so
shingles that a sample shows to be common come last: the sample decides the cost, never the result. The pigeonring chains of
simhash.py then prune the candidates' fingerprints at DISTANCE bits before the full Hamming check, and the shingle sets of what
is left are intersected before a pair counts as linked. DISTANCE is three and a half standard deviations above the mean at the
least similarity: of pairs just there about one in 5,000 is missed, of more alike ones fewer.

Texts with the same set are one node. As groups of near copies share most of their rare shingles, a shingle's nodes are first
compared with their neighbours in the order of fingerprints, then with that node of the shingle's largest component that shares
most shingles: these rounds are linear. What then still lies in different components is compared under each shingle, but for those of its largest component
with each other; a join row carries what decides whether a pair is possible, so only pairs at the brink leave the join. The
components are the same as with all pairs. A group of texts that are alike by less than the similarity costs the square of its
size in comparisons of fingerprints, not in rows.

Texts are folded and cut like those of simhash.py; one with fewer words than a shingle is one shingle, one without words has the
empty set, and a null text has no words. A row is known by its doc_id, which may be null or repeated, and a hash of its other
columns, which may have any names. Rows without doc_id count as larger than all others. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import SEED, chained, hashed, majority

#: Similarity as a fraction, so that sizes are compared in whole numbers, and bits that fingerprints may differ in.
SHINGLE, SIMILAR, DISTANCE = 5, (4, 5), 20
#: Documents that show which shingles are common, how many must hold one, and how many shingles are kept.
SAMPLE, COMMON, KNOWN = 4000, 3, 1 << 18
NEAR = 4
#: Longs of a parity sketch, and words of the bitmap by which texts are chosen before a shuffle.
PARITY, WORDS = 4, 1 << 18
LAST_ID = (1 << 63) - 1


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed(text, width)]))


def prefix(found: np.ndarray, known: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The shingles one of which any similar set's prefix shares; those in known (sorted) come last in the order."""
    p, q = similar
    size = len(found) - -(-p * len(found) // q) + 1 if len(found) else 0
    if len(known):
        late = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[:size]


def parity(found: np.ndarray) -> np.ndarray:
    """One bit a cell of hashes, set where an odd number falls: two sets differ in at least as many shingles as in bits."""
    odd = np.bincount((found & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles of several distinct sets of a sample, the most frequent ones; a bounded number reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["h"])

    n = docs.count()
    some = docs.select(common.text_of().alias("text"))
    if n > SAMPLE:
        some = some.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, (1 << 20) * SAMPLE // n))
    counts = some.distinct().mapInArrow(task, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "h").limit(KNOWN).select("h").toArrow().column("h")
    return np.sort(top.to_numpy().view(np.uint64))


def _sets(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, r, s (the set's hash), n (its size), f (the fingerprint), odd (the parity sketch) and its prefix, of rows doc_id, r and text."""
    handed = rows.sparkSession.sparkContext.broadcast(known)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            s, n, f, odd, first = [], [], [], [], []
            for t in b.column(2).to_pylist():
                blocks = list(hashed(t, SHINGLE))
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
                s.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                n.append(len(own))
                f.append(majority(blocks))
                odd.append(parity(own))
                first.append(prefix(own, handed.value).view(np.int64))
            marks = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s, f))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), next(marks), pa.array(n, pa.int64()), next(marks), pa.array(odd, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "r", "s", "n", "f", "odd", "prefix"])
        common.trim()

    return rows.select("doc_id", "r", common.text_of().alias("text")).mapInArrow(task, "doc_id long, r long, s long, n long, f long, odd array<long>, prefix array<long>")


def _fits(one: str, two: str):
    """Whether the sizes and fingerprints of two nodes allow the similarity."""
    p, q = SIMILAR
    n = [F.col(f"{x}.n") for x in (one, two)]
    return (F.least(*n) * q >= F.greatest(*n) * p) & chained(F.col(f"{one}.f"), F.col(f"{two}.f"), DISTANCE)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Candidate pairs of neighbours of one shingle (columns h, n, s, f), in the order of fingerprints, without regard to partition ends."""
    p, q = SIMILAR

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, s, f = (np.zeros(0, np.int64) for _ in range(4))
        for b in batches:
            h, n, s, f = (np.concatenate([x[-NEAR:], b.column(k).to_numpy()]) for k, x in enumerate((h, n, s, f)))
            for lag in range(1, min(NEAR, len(h) - 1) + 1):
                x, y = slice(lag, None), slice(None, -lag)
                near = (h[x] == h[y]) & (s[x] != s[y]) & (np.minimum(n[x], n[y]) * q >= np.maximum(n[x], n[y]) * p) & (np.bitwise_count((f[x] ^ f[y]).view(np.uint64)) <= DISTANCE)
                if near.any():
                    i, j = s[x][near], s[y][near]
                    pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = rows.repartitionByRange(common.task_count(rows), "h", "f", "s").sortWithinPartitions("h", "f", "s")
    found = dealt.mapInArrow(task, "a long, b long").distinct()
    return found.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))


def _labelled(rows: DataFrame) -> tuple[DataFrame, str]:
    """Of rows (h, n, s, f, deg, label): those whose shingle has several labels, with the shingle's largest label as main."""
    sizes = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("h").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).getField("label").alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    held, path = common.cut(mixed.select(F.col("h"), "main", F.col("n").alias("k")), "mixed")
    return common.spread_join(rows, held, "h", "k"), path


def _stars(rows: DataFrame, order) -> tuple[DataFrame, list[str]]:
    """Candidate pairs of each node with one node of its shingle's largest label, the one that comes last in order. One pair a row."""
    open_, path = _labelled(rows)
    central = open_.filter("label = main").groupBy("h").agg(F.max(F.struct(order.alias("o"), "s", "n", "f")).alias("c"))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    centres, there = common.cut(central.join(sizes, "h").select("h", "c.s", "c.n", "c.f", "k"), "centres")
    met = common.spread_join(open_.filter("label <> main").select("h", F.struct("s", "n", "f").alias("x"), "label", "main"), centres.select("h", F.struct("s", "n", "f").alias("y"), "k"), "h", "k")
    pairs = met.filter(_fits("x", "y")).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("label").alias("la"), F.col("main").alias("lb")).distinct()
    return pairs, [path, there]


def _crossed(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """All candidate pairs of different labels, but those of a shingle's largest label with each other. Parity sketches give a
    lower bound of the shingles in which two sets differ, so no similar pair fails them."""
    p, q = SIMILAR
    found, path = _labelled(rows)
    open_ = found.join(nodes.select("s", *[F.get("odd", k).alias(f"p{k}") for k in range(PARITY)]), "s")
    one, two = open_.filter("label <> main").alias("x"), open_.alias("y")
    other = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.s") < F.col("y.s")))
    least = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITY)])
    both = F.col("x.n") + F.col("y.n")
    # both - least over both + least is the similarity if only these shingles differ
    cross = one.join(two, (F.col("x.h") == F.col("y.h")) & other & _fits("x", "y") & ((both - least) * q >= (both + least) * p))
    return cross.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct(), [path]


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those that are not wanted (doc_id, r), so that their texts are not shuffled. A bitmap of hashes, of WORDS
    longs at most however many are wanted, is broadcast; rows that share a bit with a wanted one stay."""
    h = "xxhash64(doc_id, r)"
    word, place = F.expr(f"{h} & {WORDS - 1}").alias("w"), f"CAST(shiftright({h}, 32) & 63 AS INT)"
    bitmap = wanted.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias("bits"))
    marked = rows.select("*", word).join(F.broadcast(bitmap), "w")  # WORDS rows at most
    return marked.filter(F.expr(f"shiftright(bits, {place}) & 1 = 1")).drop("w", "bits")


def _checked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, str]:
    """A table, and its path, of the pairs a and b of nodes whose sets are similar."""
    p, q = SIMILAR
    names = pairs.columns
    pairs, path = common.cut(pairs, "pairs")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            s = np.array([xxhash.xxh64_intdigest(shingles(t).tobytes(), SEED) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield b.filter(pa.array(s == b.column(0).to_numpy()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for b in batches:
            keep = []
            for s, t, u in zip(b.column("a").to_pylist(), b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                if s != last:
                    last, x = s, shingles(t)
                y = shingles(u)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * q >= (len(x) + len(y) - both) * p)
            yield b.filter(pa.array(keep, pa.bool_())).select(names)
        common.trim()

    members = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    wanted, sought = common.cut(nodes.join(members, "s").select("s", "least.doc_id", "least.r"), "wanted")
    # a doc_id may be repeated, and r may be one of two texts
    some = _marked(rows, wanted)
    found = some.join(wanted, ["doc_id", "r"]).select("s", common.text_of().alias("text")).mapInArrow(own, "s long, text string")
    texts, there = common.cut(found.dropDuplicates(["s"]), "texts")
    one, two = (texts.select(F.col("s").alias(k), F.col("text").alias(f"t{k}")) for k in ("a", "b"))
    both = pairs.join(two, "b").join(one, "a").select(*names, "ta", "tb")
    done, made = common.cut(both.mapInArrow(task, ", ".join(f"{c} long" for c in names)), "alike")
    for old in (path, there, sought):
        common.remove(rows.sparkSession, old)
    return done, made


def _rows(docs: DataFrame) -> DataFrame:
    """docs as doc_id, which is never null, r, a hash of the whole row, and text."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), _whole(docs).alias("r"), "text")


def _whole(docs: DataFrame):
    """A hash of a row that tells nulls in different columns apart."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.xxhash64("doc_id", "text", F.col("text").isNull(), *([F.to_json(F.struct(*rest))] if rest else []))


def classes(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """A row per row of docs (doc_id, text and any others): doc_id, r (see _rows) and owner, the struct of doc_id and r of its
    class's smallest row; and the paths to remove when the rows are read."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = _rows(docs)
    sets, sets_path = common.cut(_sets(rows, _common(docs)), "sets")
    nodes, nodes_path = common.cut(sets.groupBy("s").agg(F.min(F.struct("doc_id", "r")).alias("least"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("f").alias("f"), F.max("odd").alias("odd")), "nodes")
    # one row a node: that of its smallest row
    first = sets.join(nodes.select("s", F.col("least.doc_id").alias("doc_id"), F.col("least.r").alias("r")), ["s", "doc_id", "r"]).dropDuplicates(["s"])
    posted = first.select(F.explode("prefix").alias("h"), "s")
    shared = posted.groupBy("h").count().filter("count > 1").select("h")
    held, held_path = common.cut(posted.join(shared, "h").join(nodes.select("s", "n", "f"), "s").select("h", "n", "s", "f"), "shared")
    # texts that share no rare shingle are alone; the others carry the label of the component that they are known to be in
    label, label_path = common.cut(held.groupBy("s").agg(F.count(F.lit(1)).alias("deg")).select("s", "deg", F.col("s").alias("label")), "labels")
    for k, find in enumerate((lambda _: (_neighbours(held), []), lambda x: _stars(x, F.col("deg")), lambda x: _crossed(x, nodes))):
        rows_now, rows_path = common.cut(held.join(label, "s"), "keyed") if k else (held, None)
        pairs, paths = find(rows_now)
        links, links_path = _checked(pairs, nodes, rows)
        far = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        after, after_path = common.cut(label.join(far.withColumnRenamed("node", "label"), "label", "left").select("s", "deg", F.coalesce("root", "label").alias("label")), "labels")
        for old in (label_path, links_path, *paths, *([rows_path] if rows_path else [])):
            common.remove(spark, old)
        label, label_path = after, after_path
    rooted, rooted_path = common.cut(nodes.select("s", "least", "k").join(label, "s", "left").select("s", "least", "k", F.coalesce("label", "s").alias("root")), "rooted")
    owners, owners_path = common.cut(rooted.groupBy("root").agg(F.min("least").alias("owner"), F.count(F.lit(1)).alias("n")), "owners")
    owner, owner_path = common.cut(common.spread_join(rooted, owners, "root").select("s", "owner", F.col("k").alias("n")), "owner")
    for old in (nodes_path, held_path, label_path, rooted_path, owners_path):
        common.remove(spark, old)
    return common.spread_join(sets.select("doc_id", "r", "s"), owner, "s").select("doc_id", "r", "owner"), [sets_path, owner_path]


def linked(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links reach, null if none of them has one."""
    found, _ = classes(docs)

    def given(c: str):
        return F.nullif(F.col(c), F.lit(LAST_ID))

    return found.select(given("doc_id").alias("doc_id"), given("owner.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each class its smallest row stays, once; equal rows are one."""
    found, paths = classes(docs)
    kept, _ = common.cut(found.filter("owner.doc_id = doc_id AND owner.r = r").select("doc_id", "r").distinct(), "kept")
    for old in paths:
        common.remove(docs.sparkSession, old)
    key = ["_kinfold_id", "_kinfold_row"]
    mine = docs.select("*", F.coalesce("doc_id", F.lit(LAST_ID)).alias(key[0]), _whole(docs).alias(key[1]))
    some = mine.join(kept.toDF(*key), key, "left_semi")
    return some.dropDuplicates(key).select(docs.columns)
