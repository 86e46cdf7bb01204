"""Queries do their whole job on small tables that a cut would show in."""

import pytest

from kinfold import catalog

FOLDER = "/root/testdata/sf0.001"


def documents(spark, folder, rows):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name, least", [("jn_idf_topk_fwd", 30), ("jn_name_topk", 10), ("jn_bm25_topk", 10), ("jn_char3_topk", 10), ("jn_union_channels", 10), ("jn_rrf", 5)])
def test_common_words_find(spark, tmp_path, name, least):
    """A word of 120 records still finds records: all score alike, so the smallest codes are the best."""
    folder = documents(spark, tmp_path, [(0, "walnut", "s0")] + [(k, "walnut", "s1") for k in range(1, 121)])
    got = catalog.QUERIES[name](spark, folder).collect()
    assert sorted(r["cand"] for r in got) == [2 * 10**10 + k for k in range(1, least + 1)]


@pytest.mark.parametrize("name", ["sim_levenshtein", "sim_jaro_winkler", "sim_ratio", "sim_token_set", "sim_partial", "txt_num_sim", "col_neighbour_number"])
def test_all_pairs_of_a_nation(spark, name):
    c, s = (spark.read.parquet(f"{FOLDER}/{t}.parquet").collect() for t in ("customer", "supplier"))
    want = sorted((x["c_custkey"], y["s_suppkey"]) for x in c for y in s if x["c_nationkey"] == y["s_nationkey"])
    assert sorted((r["s1"], r["cand"]) for r in catalog.QUERIES[name](spark, FOLDER).collect()) == want


def test_superset_of_all_parts(spark):
    part = spark.read.parquet(f"{FOLDER}/part.parquet").collect()
    sets = [(set(f"{p['p_name']} {p['p_type'].lower()}".split(" ")), p["p_size"]) for p in part]
    want = []
    for cand in {f"{p['p_name'].split(' ')[1]} {p['p_type'].lower()}" for p in part}:
        sizes = [n for ws, n in sets if ws >= set(cand.split(" "))]
        want.append((cand, len(sizes), max(sizes), sum(sizes)))
    got = catalog.QUERIES["l2_superset_support"](spark, FOLDER).select("cand", "sup_n", "sup_best", "sup_sum").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_tokens(spark):
    for r in catalog.QUERIES["txt_tokens"](spark, FOLDER).collect():
        assert len(r["digits"].split()) + len(r["alpha"].split()) == r["n"]


def test_siblings_whole_address(spark, tmp_path):
    """Two candidates whose addresses agree in twelve words and differ after them are not alike in all."""
    name, same = "maple harbor dental clinic north annex building seven", " ".join(f"street{chr(97 + k)}" for k in range(12))
    ends = (" ".join(f"{p}{chr(97 + k)}" for k in range(12)) for p in ("left", "right"))
    rows = [(0, f"{name} {same}", "s0"), *((k, f"{name} {same} {e}", "s1") for k, e in enumerate(ends, 1))]
    got = catalog.QUERIES["col_siblings"](spark, documents(spark, tmp_path, rows)).collect()
    assert len(got) == 2 and all(r["sib_addr"] < 100 for r in got)
