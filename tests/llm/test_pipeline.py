"""The pipeline's stages by plain versions of what they decide."""

import re
from itertools import pairwise

import corpus_pipeline as pipeline
from kinfold.llm import common, packing, pii, quality, substring

from test_simhash_wide import shingle_set, similarity

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    made = [docs]
    for name, stage in pipeline.STAGES:
        after, _ = common.cut(stage(spark, made[-1], FOLDER), "test")
        made.append(after)
    for before, after in pairwise(made[:-1]):
        assert after.columns == docs.columns
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    rows = [{r["doc_id"]: r["text"] for r in m.collect()} for m in made[:-1]]
    kept = {r["doc_id"] for r in quality.judged(docs).filter("keep").collect()}
    assert set(rows[1]) == kept and all(rows[1][i] == rows[0][i] for i in kept)
    sets = {i: shingle_set(t) for i, t in rows[1].items()}
    left = sorted(rows[2])
    assert all(similarity(sets[a], sets[b]) < 0.8 for k, a in enumerate(left) for b in left[:k])
    assert all(any(similarity(sets[i], sets[j]) >= 0.8 for j in sets if j < i) for i in set(rows[1]) - set(rows[2]))
    owner = {}
    for i in left:
        ws = WORD.findall(rows[2][i])
        for k in range(len(ws) - substring.WINDOW + 1):
            owner.setdefault(tuple(ws[k : k + substring.WINDOW]), i)
    for i in left:
        ws, gone = WORD.findall(rows[2][i]), set()
        for k in range(len(ws) - substring.WINDOW + 1):
            if owner[tuple(ws[k : k + substring.WINDOW])] != i:
                gone |= set(range(k, k + substring.WINDOW))
        if ws and len(gone) == len(ws):
            assert i not in rows[3]
        else:
            assert WORD.findall(rows[3][i]) == [w for k, w in enumerate(ws) if k not in gone]
    for i, t in rows[4].items():
        if t != rows[3][i]:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET|SSN)\]", t)
    assert made[4].filter("n_chars <> length(text)").count() == 0
    pieces = made[5].collect()
    assert {p["doc_id"] for p in pieces} == set(rows[4]) and all(p["offset"] + p["length"] <= packing.WINDOW for p in pieces)
    assert pii.BASE and pipeline.ORACLE_SQL is None


def test_empty_and_odd(spark):
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "Some plain words stand here.", "en", "s", 3), (2, "Some plain words stand here.", "en", "s", 3)]
    docs = spark.createDataFrame(odd, common.table(spark, FOLDER, "documents").schema)
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in pipeline.STAGES:
            now, _ = common.cut(stage(spark, now, FOLDER), "odd")
        assert now.count() >= 0


def test_clashing_names(spark):
    """Columns with the names of the operators' own come through every stage as they were."""
    text = "Some plain words stand here, and the old garden is full of birds in spring."
    names = ["n_words", "n_removed", "intervals", "kept_sha256", "score", "keep", "_score", "_keep", "_base", "_spans", "_chunk", "rest", "f", "s", "odd name"]
    docs = spark.createDataFrame([(k, f"{text} Number {k}.", *[f"{n}{k}" for n in names]) for k in range(3)], ["doc_id", "text", *names])
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now, _ = common.cut(stage(spark, now, FOLDER), "names")
        assert now.columns == docs.columns
        for r in now.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
    assert now.count() >= 1
