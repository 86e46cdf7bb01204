"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b of one orderable type. Returns node and root, the smallest node that it is connected to, for every
    node but the roots themselves. Each round's edges are written to the shared folder; the round before is deleted."""
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = common.cut(ordered, "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        near, near_path = common.cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "near")
        large = common.spread_join(both, near, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        mid, mid_path = common.cut(large, "large")
        # each node now has only smaller neighbours; nodes with many of them are roots to be, whose edges point to them
        least = mid.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        held, held_path = common.cut(least, "least")
        small = common.spread_join(mid, held, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(held.select("a", "m")).distinct()
        after, there = common.cut(small, "edges")
        for old in (path, near_path, mid_path, held_path):
            common.remove(spark, old)
        changed = _state(after)
        now, path = after, there
        if changed == state:
            break
        state = changed
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
