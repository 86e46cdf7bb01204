"""The corpus pipeline: documents in, packed token pieces out.

Every stage is written as Parquet to the shared folder and reread as the next one's documents. Null ids and texts, empty tables,
repeated rows and further columns are handled as the stages' operators say; all stages but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import common, packing, pii, quality, simhash_wide, substring


def _bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs meets an operator's own columns."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("kinfold_end")).alias("rest"))


def _shaped(rows: DataFrame, docs: DataFrame, changed: bool = True) -> DataFrame:
    """Bundled rows with the columns of docs; where texts have changed, n_chars is counted anew."""

    def column(c: str):
        if c == "n_chars" and changed:
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c)

    return rows.select(*map(column, docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents, does not reject."""
    return _shaped(quality.kept(_bundled(docs)), docs, changed=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group linked by SimHash at a similarity of 0.8 or more of five-word shingles."""
    return simhash_wide.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of words that a document of smaller doc_id has; a text of which nothing is left goes."""
    rows = substring.repeats(_bundled(docs), text="text").filter("n_removed = 0 OR n_removed < n_words")
    return _shaped(rows, docs)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kinds in brackets."""
    rows = pii.with_spans(_bundled(docs))
    return _shaped(rows.withColumn("text", pii.redacted(F.col("text"), F.col("_spans"))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens by sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", remove_pii),
    ("packing", pack),
]
#: Fingerprints, trained models and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = None
    for k, (name, stage) in enumerate(STAGES):
        docs, made = common.cut(stage(spark, docs, sf_dir), f"stage-{k + 1}")
        if path:
            common.remove(spark, path)
        path = made
    return docs
