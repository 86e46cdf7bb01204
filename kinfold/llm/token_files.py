"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Documents are dealt by ranges of doc_id; each task writes one file of ids and one index beside it. A file's place in the
whole comes from a prefix sum over the files' token counts. Index layout, little-endian: 8 bytes of magic, then as 64-bit
integers the bytes per id, the document count and the end id, then doc_id (signed), a null flag and offset (count + 1) columns.

Nulls: a null text is empty, so its document holds the end id alone; a null doc_id sorts first and comes back null.
Repeated doc_ids stay separate documents, in the order of their texts. A text of any length is encoded in one piece, a few times
its bytes. Other columns are not read, so they may have any names. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common, segments

MAGIC = b"KFTOKID1"
END_ID = 2
#: Files of a run whose bases are summed up together.
RUN = 4096
MANIFEST = "part long, n_docs long, n_tokens long, data string, index string"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents (doc_id, text) below folder, a shared URI. Returns the manifest with each file's base:
    part, n_docs, n_tokens, data, index, base (ids in all files before it). Ids take 2 bytes if the vocabulary allows."""
    spark = docs.sparkSession
    common.prepare(spark)
    tokenizer = tokenizer or segments.default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = segments.library_encoder(tokenizer)
        kind = np.dtype("<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4")
        last = np.array([end_id], "<u4").tobytes()
        here = TaskContext.get()
        part, attempt = here.partitionId(), here.taskAttemptId()
        data, index = f"{folder}/part-{part:08d}.ids", f"{folder}/part-{part:08d}.idx"
        ids, null, ends, total = [], [], [], 0
        with common.open_out(f"{data}.{attempt}") as out:
            for b in batches:
                ids += b.column(0).fill_null(0).to_pylist()
                null += b.column(0).is_null().to_pylist()
                for got in encoder.render(b.column(1).to_pylist()):
                    whole = np.frombuffer(got + last, "<u4")
                    out.write(whole.astype(kind).tobytes())
                    total += len(whole)
                    ends.append(total)
        with common.open_out(f"{index}.{attempt}") as out:
            out.write(MAGIC + np.array([kind.itemsize, len(ids), end_id], "<i8").tobytes())
            out.write(np.array(ids, "<i8").tobytes() + np.array(null, "<i8").tobytes() + np.array([0, *ends], "<i8").tobytes())
        common.move(f"{data}.{attempt}", data)
        common.move(f"{index}.{attempt}", index)
        if ids:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids)], "n_tokens": [total], "data": [data], "index": [index]})

    rows = docs.select("doc_id", common.text_of().alias("text"))
    dealt = rows.repartitionByRange(common.task_count(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest, _ = common.cut(dealt.mapInArrow(task, MANIFEST), "token-files")
    # prefix sums within runs of files, and over the runs, which are few
    run = F.floor(F.col("part") / RUN).alias("run")
    inside = W.Window.partitionBy("run").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    before = W.Window.orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)
    runs = manifest.groupBy(run).agg(F.sum("n_tokens").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = manifest.select("*", run).join(runs, "run").withColumn("base", F.col("first") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.select(*manifest.columns, "base")


def load(data: str, index: str):
    """(doc ids, null flags, offsets, ids) of one written file, as views of the mapped bytes."""
    import numpy as np

    head = common.map_file(index)
    if bytes(head[:8]) != MAGIC:
        raise ValueError(f"{index} is no token index")
    width, n, _ = np.frombuffer(head, "<i8", 3, 8)
    columns = np.frombuffer(head, "<i8", 3 * n + 1, 32)
    body = common.map_file(data)
    return columns[:n], columns[n : 2 * n], columns[2 * n :], np.frombuffer(body, f"<u{width}", len(body) // width)


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, null, at, tokens = load(row["data"], row["index"])
                for i in range(0, len(ids), 10_000):
                    k = range(i, min(i + 10_000, len(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if null[j] else int(ids[j]) for j in k], pa.int64()),
                            pa.array([row["base"] + int(at[j]) for j in k], pa.int64()),
                            pa.array([int(at[j + 1] - at[j]) for j in k], pa.int64()),
                            pa.array([zlib.crc32(tokens[at[j] : at[j + 1]].astype("<u4")) for j in k], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = common.task_count(manifest)
    return manifest.repartition(n, "part").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(common.table(spark, sf_dir, "documents"), common.scratch(spark, "ids")))
