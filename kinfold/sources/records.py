"""Record views: codes, three sources, a block, a name and an address."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kinfold.functions import text as X

OFFSET = 10_000_000_000
_made: dict[tuple, str] = {}
_schemas: dict[tuple, StructType] = {}
#: Shuffle files of a plan go when it has run. A setting of Spark 4.1; others ignore it.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RAW = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw records; empty strings and words like NA stay as they are."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=RAW, nullValue="\0", emptyValue="")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns], decode(F.col("entity_id")).alias("code"))


def decode(entity_id: Column) -> Column:
    """S2-00047 as source times 10^10 plus number."""
    return F.substring(entity_id, 2, 1).cast("long") * OFFSET + F.substring(entity_id, 4, 20).cast("long")


def encode(code: Column) -> Column:
    """The way back: a number of fewer than five digits is padded, a longer one stays whole."""
    number = (code % OFFSET).cast("string")
    return F.concat(F.lit("S"), source_of(code).cast("string"), F.lit("-"), F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0")))


def source_of(code: Column) -> Column:
    return F.floor(code / OFFSET).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def _clean(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="kinfold-")
    return f"{base.rstrip('/')}/kinfold-{name}-{uuid.uuid4().hex}"


def put(rows: DataFrame, path: str, *by: str) -> None:
    """rows written at path beside what is there, in a folder for each value of by; what they were shuffled for goes at once."""
    with _clean(rows.sparkSession):
        rows.select("*").write.mode("append").partitionBy(*by).option("compression", "zstd").parquet(path)


def cut(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """rows written to the shared folder and read from there, and where."""
    path = scratch(rows.sparkSession, name)
    put(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def written(spark: SparkSession, rows: DataFrame | Callable[[], tuple[DataFrame, str]], source: str, name: str) -> DataFrame:
    """rows, which follow from the files at source alone, written once a session to the shared folder, and read from there as long
    as those files stay as they are. A function writes them itself and gives them as read, and their path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(source)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, source, name, store.getFileStatus(where).getModificationTime(), store.getContentSummary(where).getLength())
    if key not in _made:
        got, _made[key] = rows() if callable(rows) else cut(rows, name)
        _schemas[key] = got.schema
        atexit.register(forget, spark, _made[key])
    return spark.read.schema(_schemas[key]).parquet(_made[key])


def forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may already be gone
        pass


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as they are, with the codes, sources and blocks of their records."""
    src = (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 3 + 1).alias("src")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("country"), src)
    return rows.select("doc_id", (F.col("src").cast("long") * OFFSET + F.col("doc_id")).alias("code"), "src", "country", "text")


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts with name, the first eight words of the normalised text, and addr, the rest."""
    rows = texts(spark, sf_dir).withColumn("n", X.normalize(F.col("text"))).withColumn("name", F.substring_index("n", " ", 8))
    return rows.withColumn("addr", F.substring("n", F.length("name") + 2, F.length("n"))).drop("n")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: the block is the language, the source follows from the source's number, the name is the first
    eight words and the address the rest. nt and at are their words. Texts are normalised once a session; what follows from name
    and addr is not written, nor is text, which documents have."""
    rows = written(spark, normalised(spark, sf_dir).drop("text"), f"{sf_dir}/documents.parquet", "records")
    return rows.select("doc_id", "code", "src", "country", X.tokens(F.col("name")).alias("nt"), X.tokens(F.col("addr")).alias("at"), "name", "addr")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records without their addresses, which are most of what records() writes: name and nt, n_at, the number of the address's words,
    and k, which is the same for equal texts. Written once a session."""
    rows = normalised(spark, sf_dir).withColumns({"n_at": F.size(X.tokens(F.col("addr"))), "k": _key()}).drop("text", "addr")
    rows = written(spark, rows, f"{sf_dir}/documents.parquet", "names")
    return rows.select("doc_id", "code", "src", "country", X.tokens(F.col("name")).alias("nt"), "name", "n_at", "k")


def _key() -> Column:
    return F.unhex(F.sha2(F.concat_ws(" ", "name", "addr"), 256))


def terms(spark: SparkSession, sf_dir: str, name: str, of: Callable[[Column, Column], Column], view: Callable = records) -> DataFrame:
    """code, country, src and terms of records, each term once: what of() makes of nt and at. Written under this name once a session,
    since a search reads them several times. The view is names() where of() needs no at."""
    rows = view(spark, sf_dir).select("code", "country", "src", F.array_distinct(of(F.col("nt"), F.col("at"))).alias("terms"))
    return written(spark, rows, f"{sf_dir}/documents.parquet", f"terms-{name}")


#: Pairs are shuffled in turns of about so many, of which there are at most so many, since each reads the whole table.
TURN_ROWS, TURNS = 8_000_000, 4


def in_turns(rows: DataFrame, first: str, f: Callable, then: str, g: Callable, name: str) -> tuple[DataFrame, str]:
    """g(f(rows)) written to the shared folder, and where, for an f that needs a value's rows of column first together, and a g that
    needs those of column then. The values are dealt to turns, so that the disk holds the shuffled rows of one turn alone."""
    spark = rows.sparkSession
    n = max(1, min(TURNS, -(-rows.count() // TURN_ROWS)))

    def turn(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    half, path = scratch(spark, f"{name}-half"), scratch(spark, name)
    for k in range(n):
        part = f(rows.filter(turn(first) == k).repartition(first))
        put(part.withColumn("_turn", turn(then)), half, "_turn")
    for k in range(n):
        got = g(spark.read.schema(StructType([*part.schema, StructField("_turn", IntegerType())])).parquet(half).filter(F.col("_turn") == k).drop("_turn"))
        put(got, path)
        forget(spark, f"{half}/_turn={k}")
    forget(spark, half)
    return spark.read.schema(got.schema).parquet(path), path


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored pairs, one row a pair: s1, cand, src, prob and label."""
    return unique(claims(spark, sf_dir)).withColumn("src", (F.col("cand") % 2 + 2).cast("int"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored pairs, one row a claim: s1, cand, prob and label."""
    prob = F.round(F.col("l_discount") * 8 + F.col("l_tax") * 2, 6)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand"), prob.alias("prob"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def unique(rows: DataFrame) -> DataFrame:
    """The best claim of each pair."""
    return rows.groupBy("s1", "cand").agg(F.max("prob").alias("prob"), F.max("label").alias("label"))


def owners(rows: DataFrame) -> DataFrame:
    """Truth from equal texts: s1 (the smallest code of source 1 with the text in its block) and m, the codes of the other sources with it.
    rows: records() or names()."""
    keyed = rows if "k" in rows.columns else rows.withColumn("k", _key())
    first = keyed.filter("src = 1").groupBy("country", "k").agg(F.min("code").alias("s1"))
    return keyed.filter("src > 1").join(first, ["country", "k"]).select("s1", F.col("code").alias("m"))
