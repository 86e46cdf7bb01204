"""Work and disk of queries grow with their input and their result, not with what lies between."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinfold import catalog
from kinfold.sources import records as R

from compare import cells, oracle

FOLDER = "/root/testdata/sf0.001"


def nodes(node):
    """An executed plan's nodes, those of its finished stages too."""
    yield node
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(node.plan())
    for k in range(node.children().size()):
        yield from nodes(node.children().apply(k))


def joined(df):
    """The rows of the largest join that a query runs."""
    df.collect()
    made = [0]
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if "Join" in node.getClass().getSimpleName() and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
    return max(made)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """60 records of the first source and 600 others, all of which share words of the name and of the address: 36,000 pairs."""
    folder = tmp_path_factory.mktemp("crowded")
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(k, f"walnut street number{k % 7} a b c d e walnut street number{k % 5}", "en", "s0" if k < 60 else "s1", 10) for k in range(660)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


HITS = ["jn_name_topk", "agg_anchor_stats", "agg_misses", "agg_recall_at_k", "sim_core_counts", "sim_counts", "sim_raw_ratio", "col_mismatch_idf", "jn_anchor", "jn_label_pairs", "agg_union_recall", "jn_addr_topk", "jn_anti_new", "jn_caddr_topk"]


@pytest.mark.parametrize("name", HITS)
def test_pairs_that_share_a_word_are_no_rows(spark, crowded, name):
    assert joined(catalog.QUERIES[name](spark, crowded)) < 20_000


def test_records_hold_no_text_twice(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten", "en", "s1", 9), (2, None, "en", "s1", 0), (3, " Straße ", "en", "s0", 6)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    rows = R.records(spark, str(tmp_path))
    assert [(r["nt"], r["at"], r["name"], r["addr"]) for r in rows.orderBy("doc_id").collect()] == [("one two three four five six seven eight".split(), ["nine", "ten"], "one two three four five six seven eight", "nine ten"), ([], [], "", ""), (["strasse"], [], "strasse", "")]
    assert spark.read.parquet(next(v for k, v in R._made.items() if str(tmp_path) in str(k))).columns == ["doc_id", "code", "src", "country", "name", "addr"]


#: Functions that read a string: an expression of one side of a pair runs before the join, once a record.
READ = ("rlike", "RLIKE", "split(", "regexp_extract", "regexp_replace", "ltrim")


@pytest.mark.parametrize("name", ["sim_digits", "col_neighbour_number", "col_number_distance", "sim_digits_canonical", "sim_idf_overlap", "col_numbers"])
def test_sides_of_pairs_are_read_before_the_join(spark, name):
    above, *joins = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert len(joins) == 1 and not any(r in above for r in READ)


def test_siblings_carry_codes_not_texts(spark, tmp_path):
    """40 entities whose ten candidates are the same ten records: 4,000 pairs of candidates and anchors, 45 pairs of texts."""
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    same = "maple harbor dental clinic north annex building seven"
    rows = [(k, f"{same} road number {k}" if k >= 40 else same, "en", "s0" if k < 40 else "s1", 10) for k in range(50)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["col_siblings"](spark, str(tmp_path))
    assert len(df.collect()) == 400
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if "Join" in node.getClass().getSimpleName() and "addr" in node.output().toString().replace("sib_addr", ""):
            assert node.metrics().apply("numOutputRows").value() <= 45


#: Queries that need no address, which is most of what is written of a record.
NAME_QUERIES = ["agg_anchor_stats", "agg_misses", "agg_recall_at_k", "sim_core_counts", "sim_counts", "sim_raw_ratio", "col_mismatch_idf", "jn_anchor", "jn_label_pairs", "agg_union_recall", "jn_anti_new"]


@pytest.mark.parametrize("name", NAME_QUERIES)
def test_addresses_are_not_written(spark, crowded, name):
    R._made.clear()
    catalog.QUERIES[name](spark, crowded).collect()
    made = [spark.read.parquet(path).columns for path in R._made.values()]
    assert made and not any("addr" in columns for columns in made)


def test_terms_are_sent_as_one_string(spark):
    plan = catalog.QUERIES["jn_name_topk"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 3  # weights, pool and queries


def test_pairs_are_learned_from_as_tallies(spark, tmp_path):
    """40 copies of the pairs with other keys: models learn from few rows with numbers, and pairs are shuffled at most twice."""
    from kinfold.operators import learning

    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").filter("l_orderkey < 40").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39))))
    rows = rows.withColumns({"l_orderkey": F.col("l_orderkey") + F.col("i") * 1_000_000, "l_partkey": F.col("l_partkey") + F.col("i") * 1_000_000}).drop("i")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    from kinfold.plans.pair_queries import _features

    pairs, features = _features(spark, str(tmp_path))
    data, path = learning.tallied(pairs, features, learning.binned(pairs, features))
    assert data.agg(F.sum("n")).first()[0] == pairs.count() > 5 * data.count()
    R.forget(spark, path)
    df = catalog.QUERIES["ml_oof"](spark, str(tmp_path))
    assert df.count() == pairs.count() and not [n for n in nodes(df._jdf.queryExecution().executedPlan()) if "ShuffleExchange" in n.getClass().getSimpleName()]


def test_pairs_in_turns(spark, monkeypatch):
    """Features of several turns are those of one, and of the window and the join over all pairs."""
    from kinfold.operators import windows
    from kinfold.plans.pair_queries import _features

    monkeypatch.setattr(R, "TURN_ROWS", 2_000)
    R._made.clear()
    got, features = _features(spark, FOLDER)
    want = windows.context(windows.competition(R.scored(spark, FOLDER).select("s1", "cand", "prob", "label")), ["prob"])
    columns = ["s1", "cand", "label", *features]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    R._made.clear()


def test_what_is_written_leaves_no_shuffle_files(spark):
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = shuffles.size()
    got, path = R.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert got.count() == 7 and spark.conf.get(R.CLEAN, None) != "true"
    R.forget(spark, path)
    R.cut(spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count(), "test")
    assert shuffles.size() <= before + 1  # that of count()


@pytest.mark.parametrize("name, searches, kept", [("jn_anchor", 1, "anchors"), ("jn_anti_new", 1, "name-hits")])
def test_hits_are_sent_as_lists_of_one_search_at_a_time(spark, copied, name, searches, kept):
    """Groups of copies in which a record is not among its own best: what SQL gives, with one row a query sent."""
    R._made.clear()
    df = catalog.QUERIES[name](spark, copied)
    assert cells(df.toPandas()) == cells(oracle(catalog.ORACLE_SQL[name], copied, ["documents"]))
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if "FlatMapGroupsInArrow" in n.getClass().getSimpleName()]
    assert len(found) == searches and all("cands" in n.output().toString() for n in found)
    assert kept in {key[2] for key in R._made}


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """30 names of 4, 8 or 12 copies each, dealt to three sources, and names that share words with them."""
    folder = tmp_path_factory.mktemp("copied")
    names = [f"walnut{k % 3} street{k % 5} house{k} shop{k % 7}" for k in range(30)]
    rows = [f"{n} {'annex' if i % 4 == 3 else ''}" for k, n in enumerate(names) for i in range(4 * (1 + k % 3))]
    pq.write_table(pa.table({"doc_id": range(len(rows)), "text": rows, "lang": ["en"] * len(rows), "source": [f"s{i * 7 % 3}" for i in range(len(rows))], "n_chars": [9] * len(rows)}), f"{folder}/documents.parquet")
    return str(folder)
