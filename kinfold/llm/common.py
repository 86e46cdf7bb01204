"""What the operators share: shared scratch tables, code shipping, batch sizes and partition counts."""

from __future__ import annotations

import atexit
import functools
import math
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input files that one task should handle where an operator holds a task's rows together.
TASK_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
BATCH_ROWS = 4096
#: A key with more than LEAST rows and over 1 / HOT of all rows is joined by broadcast.
LEAST, HOT = 200, 4096

_shipped: set[str] = set()
_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors and bound the Arrow batches by bytes, so that long texts do not pile up."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run below spark.checkpoint.dir, or, where that is unset, a local one of this process."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        _roots[app] = f"{base.rstrip('/')}/kinfold-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may already be gone
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and reread it: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that df reads, each as often as it is read. A join's estimate is a product of its sides, a
    sum over the plan's leaves is not. Where a leaf has no known size, one aggregate measures the rows themselves."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    if all(n < 1 << 60 for n in sizes):
        return sum(sizes)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    width = functools.reduce(lambda a, b: a + b, texts, F.lit(8 * len(df.columns)))
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def task_count(df: DataFrame, bytes_per_task: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of df: the session's number, or more where the input is large for it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df) / bytes_per_task))


def piece_count(df: DataFrame, bytes_per_piece: int) -> int:
    """Groups of rows that follow the bytes that df reads alone."""
    return max(8, math.ceil(input_bytes(df) / bytes_per_piece))


def spread_join(rows: DataFrame, found: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined with found (one row a key; n: how many of rows have the key) without a task that holds one key's rows. A key is
    hot if it has over 1 / HOT of all rows, so there are fewer than HOT of them, and these are broadcast; the others are shuffled.
    rows and found are read more than once, so they should be tables or cheap."""
    total = found.agg(F.sum(n).alias("_total"))
    hot = found.crossJoin(F.broadcast(total)).filter((F.col(n) > LEAST) & (F.col(n) * HOT > F.col("_total"))).drop("_total", n)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.drop(n), key)
    return few.unionByName(rest)


def trim() -> None:
    """Give freed memory back to the system: a worker process lives on between tasks, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def local_path(uri: str) -> str | None:
    """The path of a file URI, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_out(uri: str):
    """A binary stream to a shared file; its folder is made if needed."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def move(source: str, target: str) -> None:
    """Rename; a second attempt of the same task writes the same bytes, so the last one may win."""
    if path := local_path(source):
        os.replace(path, local_path(target))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(source)
    store.move(path, fs.FileSystem.from_uri(target)[1])


def map_file(uri: str):
    """The bytes of a shared file as a buffer, memory-mapped where the store allows."""
    import pyarrow as pa

    if path := local_path(uri):
        return pa.memory_map(path, "r").read_buffer() if os.path.getsize(path) else pa.py_buffer(b"")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer()
