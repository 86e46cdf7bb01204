"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own centroids, so a pair of centroids is a cell. Nearness being
the inner product, a query's distance from a centroid is the negative product of the two. It walks the pairs in the order of their
summed distances with a heap until the cells hold a given share of all vectors; what they hold is reranked by the exact inner
product. Centroids are fitted on a bounded sample, every vector is indexed.

The share follows from the data: it is the least that finds TARGET of the nearest neighbours of sampled queries in the sample.
Among more vectors the nearest lie further out, so their cells come earlier and the share finds more. Vectors in clusters need
a small share; without any structure most vectors have to be looked at, by any index.

Cells follow each other in blocks of about BLOCK vectors; a large cell spans several, its vectors dealt by a hash of vec_id. A
query goes to the blocks that hold cells it probes, and to no other. So neither a large cell nor a group of equal vectors lands in
one task. Of equal vectors only the RANKS + 1 smallest ids can be among any query's results, as ties go to the smaller id: only
these are indexed one by one.

Vectors of each length are indexed apart, as an inner product needs two of one length. Vectors that are null, zero, or hold a
null or non-finite component take no part, nor does a null vec_id. Of several rows with one vec_id the least vector counts. Only
the two columns named are read, so others may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

RANKS = 20
#: Vectors and components that the centroids are fitted on at most, centroids a half, sampled queries and what they must find.
SAMPLE, NUMBERS, CENTROIDS, ASKED, TARGET = 20_000, 1 << 22, 32, 512, 0.95
#: Vectors of a block, queries that meet one at once, and queries of a task.
BLOCK, QUERIES, SHARED = 16_384, 256, 16_384


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(key).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)


def fit(points: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """k-means; an empty cluster takes a random point."""
    r = np.random.default_rng(seed)
    centroids = points[r.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        own = nearest(points, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[r.integers(len(points), size=len(centroids))])
    return centroids


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (row times columns plus column) by the sum of their distances, until they hold wanted vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, reached, out, held = [(x[0] + y[0], 0, 0)], [0] * len(x), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(y) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        reached[i] = j + 1
        if i + 1 < len(x) and reached[i + 1] == j:  # a pair follows when both pairs before it are out
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def exact(queries: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * found[:, d]
    return out


def fitted_share(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], ranks: int, target: float) -> float:
    """The least share of points, in the order of their cells, that holds target of the nearest neighbours of some of them."""
    if len(points) <= ranks + 1:
        return 1.0
    half = books[0].shape[1]
    cell = nearest(points[:, :half], books[0]) * len(books[1]) + nearest(points[:, half:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    asked, held = points[:ASKED], []
    for k in range(0, len(asked), 32):
        q = asked[k : k + 32]
        scores = q @ points.T
        scores[np.arange(len(q)), np.arange(k, k + len(q))] = -np.inf
        best = np.argpartition(-scores, ranks, axis=1)[:, :ranks]
        far = -((q[:, :half] @ books[0].T)[:, :, None] + (q[:, half:] @ books[1].T)[:, None, :]).reshape(len(q), -1)
        order = np.argsort(far, axis=1, kind="stable")
        sums = np.cumsum(counts[order], axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        held.append(np.take_along_axis(sums, np.take_along_axis(place, cell[best], axis=1), axis=1).ravel())
    return min(1.0, float(np.quantile(np.concatenate(held), target, method="higher")) / len(points))


def search(table: DataFrame, every: int = 20, ranks: int = RANKS, centroids: int = CENTROIDS, target: float = TARGET, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id divisible by every) among all other vectors of its length. share: if
    given, the share of vectors that a query looks at instead of the fitted one."""
    spark = table.sparkSession
    common.prepare(spark)
    points, _ = common.cut(vectors(table), "vectors")
    lengths = sorted(r["dim"] for r in points.groupBy(F.size("v").alias("dim")).count().collect())
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_search(points.filter(F.size("v") == dim), dim, every, ranks, centroids, target, share) for dim in lengths]
    return reduce(DataFrame.unionByName, parts)


def _search(points: DataFrame, dim: int, every: int, ranks: int, centroids: int, target: float, share: float | None) -> DataFrame:
    """search among points (vec_id, v) that all have dim components."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(256, min(SAMPLE, NUMBERS // dim))).select("v").toArrow()
    fitted = matrix(sample.column("v").combine_chunks())
    half = dim // 2
    books = fit(fitted[:, :half], centroids), fit(fitted[:, half:], centroids)
    share = fitted_share(fitted, books, ranks, target) if share is None else share

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1))
            cell = nearest(v[:, :half], books[0]) * len(books[1]) + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], ["vec_id", "v", "cell"])

    alike = W.Window.partitionBy("v").orderBy("vec_id")
    few = points.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= ranks + 1).select("vec_id", "v")
    index, _ = common.cut(few.mapInArrow(place, "vec_id long, v array<double>, cell long"), "index")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for row in index.groupBy("cell").count().collect():  # at most one row a cell
        counts[row["cell"]] = row["count"]
    before = np.cumsum(counts) - counts  # the place of each cell's first vector
    total = int(counts.sum())
    wanted = math.ceil(share * total)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, inside = b.column(2).to_numpy(), b.column(3).to_numpy()
            at = before[cell] + (inside * counts[cell]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at // BLOCK)], ["vec_id", "v", "cell", "block"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1))
            first, second = -(v[:, :half] @ books[0].T), -(v[:, half:] @ books[1].T)
            who, blocks, lists = [], [], []
            for k in range(len(v)):
                by: dict[int, list[int]] = {}
                for c in walk(first[k], second[k], counts, wanted):
                    for at in range(before[c] // BLOCK, (before[c] + counts[c] - 1) // BLOCK + 1):
                        by.setdefault(int(at), []).append(c)
                who += [k] * len(by)
                blocks += by
                lists += by.values()
            some = b.take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, pa.list_(pa.int64())), pa.array(blocks, pa.int64())], ["query_id", "q", "cells", "block"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
            ids, entries = left.column("vec_id").to_numpy(), matrix(left.column("v").combine_chunks())
            cuts = np.searchsorted(left.column("cell").to_numpy(), np.arange(len(counts) + 1))
            for k in range(0, right.num_rows, QUERIES):
                part = right.slice(k, QUERIES)
                own, q = part.column("query_id").to_numpy(), matrix(part.column("q").combine_chunks())
                lists = part.column("cells").to_pylist()
                probed = np.zeros((len(q), len(counts)), bool)
                for i, cells in enumerate(lists):
                    probed[i, cells] = True
                scores = np.full((len(q), len(ids)), -np.inf)
                for c in np.flatnonzero(np.diff(cuts) > 0):
                    who = np.flatnonzero(probed[:, c])
                    if len(who):
                        scores[who, cuts[c] : cuts[c + 1]] = q[who] @ entries[cuts[c] : cuts[c + 1]].T
                scores[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, max(0, scores.shape[1] - ranks), axis=1)[:, max(0, scores.shape[1] - ranks)]
                i, j = np.nonzero((scores >= least[:, None] - 1e-9 * np.abs(least[:, None])) & np.isfinite(scores))
                score = exact(q[i], entries[j])
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                top = np.arange(len(i)) - first < ranks
                out.append(np.rec.fromarrays([own[i[top]], ids[j[top]], score[top]], names="q,v,s"))
        rows = np.concatenate(out) if out else np.rec.fromarrays([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names="q,v,s")
        return pa.table({"query_id": pa.array(rows["q"], pa.int64()), "vec_id": pa.array(rows["v"], pa.int64()), "score": pa.array(rows["s"], pa.float64())})

    asked = points.filter(F.col("vec_id") % every == 0).mapInArrow(probe, "query_id long, q array<double>, cells array<long>, block long")
    # the queries of a block are dealt on, so that a task never holds them all
    shares = max(1, math.ceil(total / every / SHARED))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(shares)))
    inside = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    held = index.withColumn("inside", inside).mapInArrow(block, "vec_id long, v array<double>, cell long, block long").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    found = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    by = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= ranks).select("query_id", "rank", "vec_id", "score")


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
