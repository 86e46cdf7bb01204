"""All pairs of a nation: what the matrices give is what the column expressions give, and no join makes the pairs."""

import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold import catalog
from kinfold.functions import text as X
from kinfold.operators import collective, crossed, similarity
from kinfold.plans import text_queries as T

from test_scale import FOLDER, joined

NAMES = ["", None, "Customer#7", "Shop 007", "shop 12a", "12", "13 b 14th", "0", "00", "1234567890123", "shop 123456789012", "99999999999", "a", "12b 3", "3 12 21st", "Été 120", "102", "201", "x00", "9a 9b", "null 4", "ab 10 ab 11 10"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A nation of 600 customers and 44 suppliers, one of a few, one with customers alone, and rows of none."""
    path = tmp_path_factory.mktemp("nations")
    for t, n, by in (("customer", 620, "c"), ("supplier", 50, "s")):
        schema = spark.read.parquet(f"{FOLDER}/{t}.parquet").schema
        rows = []
        for k in range(n):
            nation = 1 if k < (600 if by == "c" else 44) else None if k % 5 == 0 else 2 if by == "s" or k % 2 else 3
            known = {f"{by}_{'cust' if by == 'c' else 'supp'}key": k, f"{by}_name": NAMES[(k * (1 if by == "c" else 5)) % len(NAMES)], f"{by}_nationkey": nation}
            rows.append([known.get(f.name) for f in schema])
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def first(name):
    return X.first_number(X.tokens(name))


def neighbour_number(spark, d):
    return T._cs(spark, d, n=first).select("s1", "cand", X.neighbour_number(F.col("a_n"), F.col("b_n")).alias("is_neighbor_number"))


def number_distance(spark, d):
    c, s = T._sides(spark, d)
    c, s = (rows.select(code, "k", *collective.number_parts(first(F.col(n)), n)) for rows, code, n in ((c, "s1", "a"), (s, "cand", "b")))
    return collective.number_distance(T._paired(c, s))


def digits(spark, d):
    rows = T._cs(spark, d, n=lambda name: similarity.digits(X.numeric(X.tokens(name))))
    return similarity.canonical_digits(rows.select("s1", "cand", F.col("a_n").alias("x"), F.col("b_n").alias("y")))


def idf_overlap(spark, d):
    own = spark.read.parquet(f"{d}/customer.parquet").select(X.tokens(X.normalize(F.col("c_name"))).alias("w"))
    n = own.count()
    import math

    weights = own.select(F.explode(F.array_distinct("w")).alias("token")).groupBy("token").agg((F.log(F.lit(n + 1.0)) - F.log(F.count(F.lit(1)) + 1)).alias("idf"))
    c, s = T._sides(spark, d)
    c = similarity.weighed(c.select("s1", "k", X.tokens(F.col("a")).alias("w")), ["s1", "k"], "w", weights, math.log(n + 1)).withColumnsRenamed({"words": "aw", "total": "at"})
    s = similarity.weighed(s.select("cand", "k", X.tokens(F.col("b")).alias("w")), ["cand", "k"], "w", weights, math.log(n + 1)).withColumnsRenamed({"words": "bw", "total": "bt"})
    return similarity.idf_overlap(T._paired(c, s))


def jaro_winkler(spark, d):
    return similarity.scored(T._cs(spark, d), "a", "b", ["jw"]).select("s1", "cand", F.col("jw").alias("name_jw"))


def ratio(spark, d):
    return similarity.scored(T._cs(spark, d), "a", "b", ["ratio", "tsort"]).select("s1", "cand", "ratio", "tsort")


def numbers(spark, d):
    rows = T._cs(spark, d, n=lambda name: X.number_facts(X.tokens(name)))
    return collective.numbers(rows.select("s1", "cand", F.col("a_n").alias("q"), F.col("b_n").alias("c")))


PLAIN = {"col_neighbour_number": neighbour_number, "col_number_distance": number_distance, "sim_digits_canonical": digits, "sim_idf_overlap": idf_overlap, "sim_jaro_winkler": jaro_winkler, "sim_ratio": ratio, "col_numbers": numbers}


@pytest.mark.parametrize("name", PLAIN)
def test_matrices_give_what_expressions_give(spark, folder, name):
    def rows(df):
        return sorted(map(repr, (tuple(None if v is None else round(float(v), 5) for v in r) for r in df.collect())))

    got = catalog.QUERIES[name](spark, folder)
    want = PLAIN[name](spark, folder)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 26_400


#: Queries whose pairs are made by matrices.
MATRICES = ["col_neighbour_number", "col_number_distance", "sim_jaro_winkler", "sim_digits_canonical", "sim_idf_overlap", "sim_ratio", "col_numbers"]


@pytest.mark.parametrize("name", MATRICES)
def test_pairs_are_no_rows_of_a_join(spark, folder, name):
    assert joined(catalog.QUERIES[name](spark, folder)) < 5_000


def scores(monkeypatch, spark, name, left, right):
    """What a query's score makes of two lists of names, as rows, and how many functions it calls in Python."""
    held, real = {}, crossed.pairs
    monkeypatch.setattr(crossed, "pairs", lambda a, b, score, columns: held.update(a=a, b=b, score=score, columns=columns) or real(a, b, score, columns))
    monkeypatch.setattr(T, "_sides", lambda s, d: tuple(s.createDataFrame([(k, 1, n) for k, n in enumerate(names)], f"{code} long, k long, {c} string") for names, code, c in ((left, "s1", "a"), (right, "cand", "b"))))
    catalog.QUERIES[name](spark, FOLDER)
    x, y = ({c: t[c].combine_chunks() for c in t.column_names} for t in (held[side].coalesce(1).toArrow() for side in "ab"))
    x, y = ({c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in side.items()} for side in (x, y))
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    got = held["score"](x, y)
    sys.setprofile(None)
    both = [got[c] if isinstance(got[c], tuple) else (got[c], None) for c in held["columns"]]
    return [[tuple(None if null is not None and null[i, j] else v[i, j] for v, null in both) for j in range(len(right))] for i in range(len(left))], calls[0]


def plain(name, a, b):
    """The rows of one pair of names by the kernels of similarity."""
    return tuple(round(similarity.KERNELS[k](a or "", b or ""), 6) for k in {"sim_ratio": ("ratio", "tsort"), "sim_jaro_winkler": ("jw",)}[name])


def calls_of_different(monkeypatch, spark, name):
    left, right = [f"customer {k:09}" for k in range(7, 90_000, 300)], [f"supplier {k:09}" for k in range(3, 60_000, 200)]
    got, calls = scores(monkeypatch, spark, name, left, right)
    assert calls < len(left) * len(right) / 10
    return left, right, got


@pytest.mark.parametrize("name", ["sim_ratio", "sim_jaro_winkler"])
def test_different_names_cost_no_call_a_pair(monkeypatch, spark, name):
    left, right, got = calls_of_different(monkeypatch, spark, name)
    assert all(got[i][j] == plain(name, left[i], right[j]) for i in range(0, 300, 7) for j in range(0, 300, 3))


@pytest.mark.parametrize("name", ["col_numbers", "sim_digits_canonical"])
def test_different_numbers_cost_no_call_a_pair(monkeypatch, spark, name):
    calls_of_different(monkeypatch, spark, name)


@pytest.mark.parametrize("name", ["sim_ratio", "sim_jaro_winkler"])
def test_names_of_any_length(monkeypatch, spark, name):
    r = random.Random(3)
    names = ["", None, "a", " ", "b a", "a b", *("".join(r.choices(r.choice(["ab ", "abcdef 012", "é漢 a1"]), k=r.choice([3, 15, 16, 17, 31, 32, 33, 63, 64, 65, 130]))) for _ in range(60))]
    left, right = names[:40], names[30:] + names[:6]
    got, _ = scores(monkeypatch, spark, name, left, right)
    assert all(got[i][j] == plain(name, a, b) for i, a in enumerate(left) for j, b in enumerate(right))


@pytest.mark.parametrize("name", ["col_numbers", "sim_digits_canonical"])
def test_parts_of_lists_give_what_the_whole_gives(monkeypatch, spark, name):
    names = [n for n in NAMES if n is not None]
    whole, _ = scores(monkeypatch, spark, name, names, names[::-1])
    monkeypatch.setattr(crossed, "CELLS", 5, raising=False)
    assert scores(monkeypatch, spark, name, names, names[::-1])[0] == whole
