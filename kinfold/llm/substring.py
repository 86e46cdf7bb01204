"""Exact substring dedup on windows of words.

A window is a run of words of one document, known by a rolling polynomial hash. A window that also starts in a document of
smaller doc_id is repeated; every word that a repeated window covers goes. Windows are judged on the input.

Documents are dealt in chunks that are ranges of doc_id, so that of two chunks the one of the smaller rank holds the smaller ids;
a doc_id of very many rows, null among them, has several chunks of one rank. Each chunk sends each of its hashes once, sorted
and as differences, to the bucket of its leading bits. A bucket counts in which chunks a hash is and answers each chunk with one
bit a hash: whether a chunk of a smaller rank has it too. Inside a chunk the first document that has a hash is known there. A
hash thus costs eight bytes a chunk, however often a chunk repeats it, and no group of equal windows meets in one task. Chunks
and buckets have a fixed size, so there is a message for each pair of them, but never more than one for a chunk's hash.

A window is known by Rabin-Karp hashes of 78 bits modulo three primes, over word hashes in which each byte counts by a value of
its own at each place. Two different windows agree in all with a chance of about 2^-78: among the 10^13 windows of 100 TB some
hundred pairs are to be expected that do, at 30 GB none.

Nulls: a null text has no words; a null doc_id counts as larger than all others. Rows of equal doc_id do not remove each
other's words, so of equal rows none is touched. Texts of fewer words than a window keep all. A chunk holds its texts, so a
very long text is a chunk of its own. An empty table gives an empty result. Other columns pass through, but for those that have
the names of added ones, which are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import Words

WINDOW, BITS = 13, 62
LAST_ID = (1 << 63) - 1
#: Input bytes of a chunk and of a bucket's windows.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Quantiles of doc_id that are asked for at most.
CUTS = 2000
#: A chunk's number is its rank times SUBS plus its place among those of its rank.
ADDED, SUBS = "kinfold_chunk", 1 << 20


def grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order, stable for equal hashes (key and check), and where in it a new hash begins."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        same = k[1:] == k[:-1]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ~same | (c[1:] != c[:-1])
    return order, fresh


class Chunk:
    """The documents of one chunk by doc_id, with their windows: at the first words, inverse their places in hashes and checks
    (sorted, each once), owner the smallest doc_id here for each hash."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").fill_null(LAST_ID).combine_chunks()
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        self.table = table.take(pa.array(order))
        self.ids = self.table.column("doc_id").fill_null(LAST_ID).to_numpy()
        text = self.table.column("text").combine_chunks()
        self.words = Words(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string()))
        self.at, keys, checks = self.words.windows(window)
        by, fresh = grouped(keys, checks)
        self.hashes, self.checks = keys[by[fresh]], checks[by[fresh]]
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[by] = np.cumsum(fresh) - 1
        self.owner = self.ids[self.words.doc[self.at[by[fresh]]]]

    def buckets(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that have some of the hashes, and where each one's begin (and the last's end)."""
        own = self.hashes >> np.uint64(shift)
        first = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
        return own[first].astype(np.int64), np.append(first, len(own))


def packed(sorted_hashes: np.ndarray, checks: np.ndarray) -> bytes:
    """Differences in as few bytes each as the largest needs, behind their width, their number and the first hash; then the checks."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    first, steps[0] = int(steps[0]), 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return bytes([width]) + len(steps).to_bytes(8, "little") + first.to_bytes(8, "little") + body + checks.astype("<u2").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, n * width, 17).reshape(n, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(int.from_bytes(data[9:17], "little")), np.frombuffer(data, "<u2", n, 17 + n * width)


def dealt(docs: DataFrame, chunks: int) -> DataFrame:
    """docs with the number of the chunk that each row falls into: a range of doc_id between quantiles, of which there are up to
    CUTS, cut evenly further. A doc_id that several quantiles fall on is a rank of its own, whose rows are dealt to as many chunks."""
    key = F.coalesce("doc_id", F.lit(LAST_ID))
    cuts = min(chunks, CUTS)
    parts = -(-chunks // cuts)
    shares = F.array(*[F.lit(k / cuts) for k in range(cuts + 1)])
    found = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * cuts)).alias("c")).first()["c"] or [0]
    edges, times = np.unique(np.array([-LAST_ID - 1, *found], np.int64), return_counts=True)

    @F.pandas_udf("long")
    def chunk(ids: pd.Series, rows: pd.Series) -> pd.Series:
        i, row = ids.to_numpy(np.int64), rows.to_numpy(np.int64)
        slot = np.searchsorted(edges, i, "right") - 1
        low, high = edges[slot].astype(np.float64), np.append(edges, LAST_ID)[slot + 1].astype(np.float64)
        inside = np.clip((i.astype(np.float64) - low) / np.maximum(high - low, 1.0), 0, 1)
        alone = (i == edges[slot]) & (times[slot] > 1)
        rank = slot * (parts + 1) + np.where(alone, 0, 1 + np.minimum((inside * parts).astype(np.int64), parts - 1))
        return pd.Series(rank * SUBS + np.where(alone, row % np.minimum(times[slot] * parts, SUBS), 0))

    return docs.withColumn(ADDED, chunk(key, F.monotonically_increasing_id()))


def repeats(docs: DataFrame, window: int = WINDOW, text: str | None = None) -> DataFrame:
    """docs with columns added: n_words, n_removed, intervals (of words: first and behind the last, maximal, in order) and
    kept_sha256 (of the kept words joined by one space). text: if given, that column is the text without the removed intervals
    and takes the place of one of that name; a text that loses nothing stays as it is."""
    common.prepare(docs.sparkSession)
    shift = BITS - math.ceil(math.log2(common.piece_count(docs, BUCKET_BYTES)))
    placed = dealt(docs, common.piece_count(docs, CHUNK_BYTES)).repartition(common.task_count(docs), ADDED)

    def send(table: pa.Table) -> pa.Table:
        chunk, number = Chunk(table.select(["doc_id", "text"]), window), table.column(ADDED)[0].as_py()
        some, at = chunk.buckets(shift)
        lists = [packed(chunk.hashes[a:b], chunk.checks[a:b]) for a, b in zip(at, at[1:])]  # noqa: B905
        del chunk
        common.trim()
        return pa.table({"bucket": pa.array(some, pa.int64()), "chunk": pa.array(np.full(len(some), number), pa.int64()), "hashes": pa.array(lists, pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        numbers, bucket = table.column("chunk").to_numpy(), table.column("bucket")[0].as_py()
        order = np.argsort(numbers, kind="stable")
        lists = [unpacked(table.column("hashes")[int(k)].as_py()) for k in order]
        sizes = np.array([len(x) for x, _ in lists])
        ranks = np.repeat(numbers[order] // SUBS, sizes)
        by, fresh = grouped(np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists]))  # in the ranks' order where equal
        least = ranks[by[fresh]][np.cumsum(fresh) - 1]
        again = np.empty(len(by), bool)
        again[by] = ranks[by] > least
        ends = np.cumsum(sizes)
        some = [(int(numbers[k]), np.packbits(bits).tobytes()) for k, bits in ((k, again[e - n : e]) for k, e, n in zip(order, ends, sizes, strict=True)) if bits.any()]
        del lists, by, fresh, ranks, least, again
        common.trim()
        return pa.table({ADDED: pa.array([k for k, _ in some], pa.int64()), "bucket": pa.array([bucket] * len(some), pa.int64()), "bits": pa.array([x for _, x in some], pa.binary())})

    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "intervals", "kept_sha256")]
    fields = [docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("intervals", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType())]
    if text and text not in names:
        fields.append(T.StructField(text, T.StringType()))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left, window)
        words, (own, at) = chunk.words, chunk.buckets(shift)
        earlier = np.zeros(len(chunk.hashes), bool)
        for k, bits in zip(np.searchsorted(own, right.column("bucket").to_numpy()).tolist(), right.column("bits").to_pylist(), strict=True):
            earlier[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[k + 1] - at[k])
        gone = earlier[chunk.inverse] | (chunk.owner[chunk.inverse] < chunk.ids[words.doc[chunk.at]])
        turns = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(turns, chunk.at[gone], 1)
        np.add.at(turns, chunk.at[gone] + window, -1)
        covered = np.cumsum(turns[:-1]) > 0
        ends = np.cumsum(words.counts)
        n_removed = np.bincount(words.doc[covered], minlength=len(chunk.ids))
        raw, sums, spans, texts = words.data.tobytes(), [], [], []
        old = chunk.table.column("text")
        for d in range(len(chunk.ids)):
            begin, end = int(words.offsets[d]), int(words.offsets[d + 1])
            if not n_removed[d]:
                sums.append(hashlib.sha256(b" ".join(raw[begin:end].split())).hexdigest())
                spans.append([])
                texts.append(old[d].as_py() if text else None)
                continue
            low, high = int(ends[d] - words.counts[d]), int(ends[d])
            mask = np.diff(covered[low:high].astype(np.int8), prepend=0, append=0)
            runs = list(zip(np.flatnonzero(mask == 1).tolist(), np.flatnonzero(mask == -1).tolist(), strict=True))
            kept, place = [], begin
            for a, b in runs:
                kept.append(raw[place : int(words.start[low + a])])
                place = int(words.start[low + b]) if low + b < high else end
            kept.append(raw[place:end])
            sums.append(hashlib.sha256(b" ".join(b"".join(kept).split())).hexdigest())
            spans.append([list(x) for x in runs])
            texts.append(b"".join(kept).decode())
        columns = {c: chunk.table.column(c) for c in names}
        columns |= {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "intervals": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept_sha256": pa.array(sums, pa.string())}
        if text:
            columns[text] = pa.array(texts, pa.string())
        return pa.table(columns)

    sent = placed.groupBy(ADDED).applyInArrow(send, "bucket long, chunk long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(judge, f"{ADDED} long, bucket long, bits binary")
    return placed.groupBy(ADDED).cogroup(answers.groupBy(ADDED)).applyInArrow(remove, T.StructType(fields))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i)),
fst AS (SELECT s, min(doc_id) AS owner FROM win GROUP BY s),
hit AS (SELECT win.doc_id, i FROM win JOIN fst USING (s) WHERE owner < win.doc_id),
cov AS (SELECT DISTINCT doc_id, i + o AS p FROM hit, unnest(range(0, 13)) AS t(o)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
