"""Near-duplicates by 64-bit SimHash fingerprints, with candidates from the pigeonring principle.

Cut into five segments on a ring, two fingerprints that differ in at most four bits have a segment from which every chain of
l consecutive segments differs in at most l * 4 / 5 bits: none in the first, at most one in two, two in three, three in four.
Halves of the second and third segment then agree in one of five ways, each 26 bits long with the first segment, and these are
the join keys. The chains are checked before the whole distance.

Texts that are alike put many fingerprints under one key. Neighbours in sorted order are therefore linked first; under a key,
only fingerprints of different components are compared afterwards, and those of the key's largest component not with each
other; a key of many fingerprints is cut further by five parts of its other bits, one of which a pair in reach agrees in. The
components are the same as with all pairs. Only distinct fingerprints take part, documents join them at the end; fingerprints and
components of very many rows are joined by broadcast (common.spread_join), so that none lands in one task.

Nulls: a null text has no words; a text without words has fingerprint zero, which links like any other. A null doc_id is kept
but names a component only if all its documents are null. Repeated rows link by their equal fingerprints. An empty table gives
no rows. Only doc_id and text are read, so other columns may have any names. A text of any length is hashed in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: First bit and width of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Sorted neighbours that are tried before the join.
NEAR = 8
#: Fingerprints of a key above which its pairs are sought by a further part of their bits.
FINE = 64
BLOCK = 1 << 16


def hashed(text: str, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, in blocks; one of the whole text if it has fewer words, none without words."""
    import xxhash

    words = text.encode().lower().split()  # on bytes both act on ASCII alone
    if not words:
        return
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(line, SEED)], np.uint64)
        return
    at = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - shingle + 1
    for k in range(0, n, BLOCK):
        yield np.array([digest(line[a : b - 1], SEED) for a, b in zip(at[k : min(k + BLOCK, n)], at[k + shingle :])], "<u8")  # noqa: B905


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint: each bit that over half of the hashes have."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return majority(hashed(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and f, the fingerprint as a signed integer."""
    common.prepare(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["doc_id", "f"])
        common.trim()

    return docs.select("doc_id", common.text_of().alias("text")).mapInArrow(task, "doc_id long, f long")


def _bits(first: int, width: int) -> int:
    mask = ((1 << width) - 1) << first
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(*segments: int) -> int:
    mask = sum(((1 << w) - 1) << a for a, w in (SEGMENTS[s % 5] for s in segments))
    return mask - (1 << 64) if mask >> 63 else mask


def _halves(segment: int) -> tuple[int, int]:
    first, width = SEGMENTS[segment % 5]
    return _bits(first, 7), _bits(first + 7, width - 7)


def _ways(s: int) -> tuple[int, ...]:
    """The five ways in which halves of the two segments behind s agree."""
    (p, q), (r, t) = _halves(s + 1), _halves(s + 2)
    return p | q, p | r, p | t, q | r, q | t


def _keys(f) -> list:
    """(start segment and way, key) of the five starts and of the five ways in which what follows agrees."""
    out = []
    for s in range(5):
        for way, mask in enumerate(_ways(s)):
            out.append(F.struct(F.lit(5 * s + way).alias("w"), F.xxhash64(F.lit(5 * s + way), f.bitwiseAND(F.lit(_mask(s) | mask))).alias("key")))
    return out


def _ring(x, start: int, distance: int):
    """Whether every chain of segments of x, the differing bits, keeps its budget from start on, and all of them the distance."""
    own = F.bit_count(x) <= distance
    for n in range(1, 5):
        own &= F.bit_count(x.bitwiseAND(F.lit(_mask(*range(start, start + n))))) <= n * distance // 5
    return own


def chained(a, b, distance: int):
    """Whether some segment starts a ring of chains within budget, and the whole distance; no pair within the distance lacks one."""
    return functools.reduce(lambda p, q: p | q, [_ring(a.bitwiseXOR(b), start, distance) for start in range(5)])


def _chains(s, a, b):
    """The same from segment s."""
    ok = None
    for start in range(5):
        own = _ring(a.bitwiseXOR(b), start, DISTANCE)
        ok = F.when(s == start, own) if ok is None else ok.when(s == start, own)
    return ok


def _finer() -> list[int]:
    """By start segment, way and part: one of five parts of the bits that the way's key leaves open. Of two fingerprints under one
    key, at most DISTANCE of these differ, so they agree in one part."""
    out = []
    for s in range(5):
        for mask in _ways(s):
            bits = [b for b in range(64) if not (_mask(s) | mask) >> b & 1]
            for part in range(5):
                own = sum(1 << b for b in bits[part::5])
                out.append(own - (1 << 64) if own >> 63 else own)
    return out


def _neighbours(rows: DataFrame) -> DataFrame:
    """Links between sorted neighbours of one key (columns key and f), without regard to partition ends: more are found later."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            keys, marks = np.concatenate([keys[-NEAR:], b.column(0).to_numpy()]), np.concatenate([marks[-NEAR:], b.column(1).to_numpy()])
            for lag in range(1, min(NEAR, len(keys) - 1) + 1):
                near = (keys[lag:] == keys[:-lag]) & (np.bitwise_count((marks[lag:] ^ marks[:-lag]).view(np.uint64)) <= DISTANCE)
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(marks[lag:][near]), pa.array(marks[:-lag][near])], ["a", "b"])

    dealt = rows.repartitionByRange(common.task_count(rows), "key", "f").sortWithinPartitions("key", "f")
    return dealt.mapInArrow(task, "a long, b long")


def classes(marks: DataFrame) -> tuple[DataFrame, str]:
    """marks: f, distinct. Returns a table of f and root, the smallest fingerprint that it is linked with over any chain, and its path."""
    spark, f = marks.sparkSession, F.col("f")
    start = F.explode(F.array(*[F.xxhash64(F.lit(s), f.bitwiseAND(F.lit(_mask(s, s + 1)))) for s in range(5)])).alias("key")
    near = components(_neighbours(marks.select(start, "f")))
    label = F.coalesce("root", "f").alias("label")
    known, path = common.cut(marks.join(near.withColumnRenamed("node", "f"), "f", "left").select("f", label), "marks")
    keyed = known.select("f", "label", F.explode(F.array(*_keys(f))).alias("k")).select("f", "label", "k.w", "k.key")
    sizes = keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).getField("label").alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    held, there = common.cut(mixed.select("key", "main", "n"), "mixed")
    rows = common.spread_join(keyed, held.withColumn("big", F.col("n") > FINE), "key")
    # under a key of many fingerprints, pairs are sought by a further part of their bits
    part = F.col("w") * 5 + F.col("p")
    fine = rows.filter("big").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("key", F.xxhash64("key", part, f.bitwiseAND(F.get(F.array(*map(F.lit, _finer())), part)))).drop("p")
    open_ = rows.filter("NOT big").unionByName(fine)
    one, two = open_.filter("label <> main").alias("x"), open_.alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.f") < F.col("y.f")))
    links = one.join(two, (F.col("x.key") == F.col("y.key")) & apart & _chains(F.floor(F.col("x.w") / 5), F.col("x.f"), F.col("y.f")))
    far = components(links.select(F.col("x.label").alias("a"), F.col("y.label").alias("b")))
    done, whole = common.cut(known.join(far.withColumnRenamed("node", "label"), "label", "left").select("f", F.coalesce("root", "label").alias("root")), "classes")
    for old in (path, there):
        common.remove(spark, old)
    return done, whole


def linked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id, the smallest doc_id that links reach."""
    spark = docs.sparkSession
    rows, _ = common.cut(fingerprints(docs, shingle), "fingerprints")
    marks, path = common.cut(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    found, there = classes(marks.select("f"))
    least, last = common.cut(found.join(marks, "f").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots")
    named, _ = common.cut(common.spread_join(found, least, "root").select("f", "component_id").join(marks.select("f", "n"), "f"), "named")
    for old in (path, there, last):
        common.remove(spark, old)
    return common.spread_join(rows, named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))
