"""Hand-written cases and brute force for the text rules, the similarities and the decisions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import collective, decision, retrieval, similarity, windows


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b", [("properties", "prprts"), ("praaprttiis", "prprts"), ("delhi", "tl"), ("dillii", "tl"), ("limited", "lmt"), ("phone", "fn"), ("123", "123")])
def test_skeleton(spark, a, b):
    assert one(spark, X.skeleton(F.col("a")), a=a) == b


@pytest.mark.parametrize("a,b,v", [("324", "32", 0.8), ("18704", "8704", 0.8), ("5", "5", 1.0), ("123", "143", 0.6), ("12", "98", 0.0)])
def test_number_similarity(spark, a, b, v):
    assert one(spark, X.number_similarity(F.col("a"), F.col("b")), a=a, b=b) == v


def test_numbers(spark):
    got = one(spark, X.number_tokens(F.split(F.col("a"), " ")), a="77th 002 12a main 0")
    assert [(r["raw"], r["can"]) for r in got] == [("77", "77"), ("002", "2"), ("12a", "12a"), ("0", "0")]


@pytest.mark.parametrize("q,c,k", [("b0b", "bob", 0), ("abc", "cab", 1), ("shop", "shops", 2), ("shops", "shop", 3), ("cat", "cut", 4), ("cat", "dog", 5)])
def test_edit_class(spark, q, c, k):
    assert one(spark, X.edit_class(F.col("q"), F.col("c")), q=q, c=c) == k


def test_normalize(spark):
    assert one(spark, X.normalize(F.col("a")), a="  Crème & Straße-Ñandú 42 ") == "creme strasse nandu 42"
    assert spark.range(1).select(X.normalize(F.lit(None).cast("string")).alias("x")).first()["x"] == ""


def test_lcs():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs(a, b) == table[-1][-1]


def test_ratios():
    assert similarity.ratio("", "") == 100 and similarity.ratio("abcd", "abxd") == 75
    assert similarity.token_sort("b a", "a b") == 100
    assert similarity.token_set("new york mets", "mets new") == 100 and similarity.token_set("", "a") == 0 and similarity.token_set("a", "b") == 0
    assert similarity.partial("bhg", "the bhg group") == 100
    assert round(similarity.jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert collective.residual("acme trading co".split(), "acme tradng inc".split()) == (["co"], ["inc"])
    assert collective.residual("delhi foods".split(), "dillii kitchen".split()) == (["foods"], ["kitchen"])
    assert collective.residual(["aaa"], ["eee"]) == (["aaa"], ["eee"])  # without consonants there is no skeleton


def test_sound(spark):
    words = ["properties", "praaprttiis", "delhi", "phone", "0012", "aeiou", "xylophone", "a1b2", "bb", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.skeleton(F.col("w")).alias("s")).collect()
    assert all(X.sound(r["w"]) == r["s"] for r in rows)


def test_keys(spark):
    import zlib

    keys = ["T|prprts|12", "N|a|b", "", "é"]
    for r in spark.createDataFrame([(k,) for k in keys[:3]], "k string").select("k", X.key_hash(F.col("k")).alias("h")).collect():
        b = r["k"].encode()
        assert r["h"] == ((zlib.crc32(b) << 32) | zlib.crc32(b[::-1])) - (1 << 63)
    assert one(spark, X.address_key(F.split(F.col("a"), " ")), a="unknown 0012 main street none nan") == "12|main street"


def test_codec(spark):
    from kinfold.sources import records as R

    codes = [1 * R.OFFSET + 7, 2 * R.OFFSET + 47, 3 * R.OFFSET + 123_456_789]
    got = spark.createDataFrame([(c,) for c in codes], "c long").select("c", R.encode(F.col("c")).alias("i")).select("c", "i", R.decode(F.col("i")).alias("d")).collect()
    assert [r["i"] for r in got] == ["S1-00007", "S2-00047", "S3-123456789"] and all(r["c"] == r["d"] for r in got)


def test_files(spark, tmp_path):
    """Raw records from a TSV file; lists to one and back; nothing is overwritten."""
    from kinfold.operators import output
    from kinfold.sources import records as R

    (tmp_path / "raw.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-00001\tNA\t\tIndia\nS2-00012\tnull\t12 A\tUS\n")
    got = [tuple(r) for r in R.read_tsv(spark, str(tmp_path / "raw.tsv")).orderBy("code").collect()]
    assert got == [("S1-00001", "NA", "", "India", R.OFFSET + 1), ("S2-00012", "null", "12 A", "US", 2 * R.OFFSET + 12)]
    entities = spark.createDataFrame([(k, 100 - k) for k in range(20)], "pos long, s1 long")
    pairs = spark.createDataFrame([(100, 3), (100, 2), (99, 5), (100, 2)], "s1 long, cand long")
    rows = output.lists(entities, pairs)
    output.write_lists(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()
    assert [r["source1_entity_id"] for r in back] == [str(100 - k) for k in range(20)]
    assert back[0]["matched_entity_ids"] == "2,3" and back[1]["matched_entity_ids"] == "5"
    with pytest.raises(Exception):
        output.write_lists(rows, str(tmp_path / "out"))


def brute(ps, missed):
    best = (0, -1.0)
    for k in range(len(ps) + 1):
        value = 0.0
        for outcome in itertools.product((0, 1), repeat=len(ps)):
            chance = 1.0
            for p, o in zip(ps, outcome):
                chance *= p if o else 1 - p
            tp, n = sum(outcome[:k]), sum(outcome)
            f = (1.0 if n == 0 and missed == 0 else 0.0) if k == 0 else 1.25 * tp / (0.25 * (n + missed) + k)
            value += chance * f
        if value > best[1] + 1e-12:
            best = (k, value)
    return best


def test_expected_f(spark):
    r = random.Random(7)
    cases = {i: sorted((round(r.betavariate(0.6, 0.6), 6) for _ in range(r.randrange(1, 8))), reverse=True) for i in range(60)}
    cases |= {100: [0.4], 101: [0.05, 0.03], 102: [0.45] * 5}
    rows = spark.createDataFrame([(i, j, p) for i, ps in cases.items() for j, p in enumerate(ps)], "s1 long, cand long, prob double")
    for row in decision.expected_f(rows).collect():
        k, value = brute(cases[row["s1"]], 0)
        assert abs(row["value"] - value) < 1e-8 and row["k"] == k
    assert {r["s1"]: r["k"] for r in decision.expected_f(rows.filter("s1 = 100"), 1.0).collect()} == {100: 1}


def test_f_beta(spark):
    truth = spark.createDataFrame([(1, 1), (2, None), (3, 5), (3, 6), (4, None)], "s1 long, m long")
    pred = spark.createDataFrame([(1, 1), (1, 1), (3, 5), (4, 9)], "s1 long, cand long")
    got = {r["s1"]: r["f"] for r in decision.scores(decision.counted(truth, pred)).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.25 / (0.25 * 2 + 1), 4: 0.0}
    assert decision.unknown(truth, spark.createDataFrame([(9, 1)], "s1 long, cand long")).count() == 1
    with pytest.raises(ValueError):
        decision.strict(truth, spark.createDataFrame([(9, 1)], "s1 long, cand long"))
    assert {r["s1"]: r["f"] for r in decision.strict(truth, pred).collect()} == got


def test_exclusive_ties(spark):
    rows = spark.createDataFrame([(2, 10, 0.5), (1, 10, 0.5), (1, 11, 0.2)], "s1 long, cand long, prob double")
    assert {(r["s1"], r["cand"]) for r in decision.exclusive(rows).collect()} == {(1, 10), (1, 11)}


def test_context_nan(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (1, 3, 0.5)], "s1 long, cand long, v double")
    got = {r["cand"]: (r["n_cands"], r["v_gap"], r["v_rank"]) for r in windows.context(rows, ["v"]).collect()}
    assert got == {1: (3, 0.0, 1), 2: (3, None, None), 3: (3, 0.0, 1)}


def test_superset(spark):
    t = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "s1 long, words array<string>")
    c = spark.createDataFrame([(7, ["c", "a"]), (8, ["z"]), (9, [])], "cand long, words array<string>")
    assert {tuple(r) for r in retrieval.superset(t, c).collect()} == {(1, 7)}
