"""Result files and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per entity (s1, pos) in the order of pos: the ids of its candidates, sorted and joined by commas, '' for none."""
    got = pairs.select("s1", "cand").distinct().groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cand")), lambda c: c.cast("string")), ",").alias("ids"))
    return entities.join(got, "s1", "left").select("pos", "s1", F.coalesce("ids", F.lit("")).alias("ids"))


def write_lists(rows: DataFrame, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> None:
    """A TSV file per range of pos; an existing path is never overwritten."""
    out = rows.orderBy("pos").select(F.col("s1").cast("string").alias(header[0]), F.col("ids").alias(header[1]))
    out.write.mode("errorifexists").csv(path, sep="\t", header=True, emptyValue="", quote="")


def integrity(entities: DataFrame, matches: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Counts that must be zero: repeated and unknown entities, ids that are not known, matches that are no candidates."""
    checks = {
        "dup_entities": entities.groupBy("s1").count().filter("count > 1"),
        "unknown_entities": matches.select("s1").distinct().join(entities, "s1", "left_anti"),
        "unknown_ids": matches.select("cand").distinct().join(known.select("cand"), "cand", "left_anti"),
        "not_candidates": matches.join(candidates, ["s1", "cand"], "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def verified(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """lines: s1, ids as read back. A row per fault and how often: repeated entity, repeated id in a list, id not of digits, missing and extra entities."""
    ids = F.filter(F.split("ids", ","), lambda x: x != "")
    faults = {
        "dup_row": lines.groupBy("s1").count().filter("count > 1"),
        "dup_id": lines.filter(F.size(ids) > F.size(F.array_distinct(ids))),
        "bad_id": lines.filter(F.exists(ids, lambda x: ~x.rlike("^[0-9]+$"))),
        "missing": entities.join(lines, "s1", "left_anti"),
        "extra": lines.join(entities, "s1", "left_anti"),
    }
    out = None
    for name, rows in faults.items():
        one = rows.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def write_by_block(rows: DataFrame, path: str, block: str = "country") -> None:
    """Parquet folders by block; the commit protocol shows a reader whole files only."""
    rows.write.partitionBy(block).mode("errorifexists").parquet(path)


def counted(lines: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows, entities, ids and empty rows of written lists (s1, ids), beside the entities that are expected."""
    ids = F.size(F.filter(F.split("ids", ","), lambda x: x != ""))
    own = lines.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("s1").alias("n_entities"), F.sum(ids).alias("n_ids"), F.sum((F.col("ids") == "").cast("int")).alias("n_empty"))
    return own.crossJoin(entities.agg(F.count(F.lit(1)).alias("n_expected")))  # one row each
