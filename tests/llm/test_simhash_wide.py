"""Near-dedup of the pipeline against all pairs of shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from kinfold.llm import common, simhash_wide

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def owners(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return [best[root(i)] for i in range(len(rows))]


def corpus():
    r = random.Random(6)
    rows, line = [], " ".join(f"c{i}" for i in range(30))
    for base in range(12):
        ws = [f"b{base}w{r.randrange(400)}" for _ in range(r.randrange(60, 400))]
        rows.append((len(rows), " ".join(ws) + " " + line))
        for edits in (1, 2, 3, 5, 8, 12, 20):
            other = list(ws)
            for k in r.sample(range(len(ws)), min(edits, len(ws))):
                other[k] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(other) + " " + line))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, rows[3][1]), (3, rows[20][1])]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("sample", [simhash_wide.SAMPLE, 20])
def test_all_pairs(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash_wide, "SAMPLE", sample)
    rows = corpus()
    got = simhash_wide.linked(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((d, o) for (d, _), o in zip(rows, owners(rows), strict=True))


def test_stage_drops_near_copies(spark):
    """Copies at 0.8 to 0.95 go, one below 0.8 stays."""
    base = [f"w{i}" for i in range(404)]  # 400 shingles
    rows, expected = [(0, " ".join(base))], {0}
    for n, edits in enumerate((2, 4, 6, 8, 9), 1):  # each edit replaces five shingles on either side
        other = list(base)
        for k in range(edits):
            other[20 + 40 * k] = f"x{n}y{k}"
        rows.append((n, " ".join(other)))
        s = similarity(shingle_set(rows[0][1]), shingle_set(rows[n][1]))
        assert s < 0.8 if edits == 9 else 0.8 <= s <= 0.96
        expected |= {n} if edits == 9 else set()
    # without word 8 in common, the last one is linked with no other copy either
    last = rows[-1][1].split()
    last[8::40] = [f"z{k}" for k in range(len(last[8::40]))]
    rows[-1] = (rows[-1][0], " ".join(last))
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == expected


def test_empty_and_null(spark):
    assert simhash_wide.keep_one(frame(spark, [])).count() == 0
    assert simhash_wide.keep_one(frame(spark, [(None, "a b"), (None, "a b"), (2, "a b"), (5, "a b")])).select("doc_id").collect() == [(2,)]
    nameless = [r["text"] for r in simhash_wide.keep_one(frame(spark, [(None, "a b"), (None, "a b"), (None, "c d")])).collect()]
    assert sorted(nameless) == ["a b", "c d"]
    # rows of one id and one text that differ elsewhere, and a copy with another id
    docs = spark.createDataFrame([(1, "a b", None, "x"), (1, "a b", "x", None), (7, "a b", "y", "y"), (1, None, "a b", "x")], "doc_id long, text string, lang string, _r string")
    assert sorted(str(r["text"]) for r in simhash_wide.keep_one(docs).collect()) == ["None", "a b"]


def test_prefix_shares():
    r = np.random.default_rng(5)
    known = np.sort(r.integers(0, 1 << 63, 50, dtype=np.uint64))
    for _ in range(200):
        both = np.unique(np.concatenate([r.choice(known, 20, replace=False), r.integers(0, 1 << 63, 60, dtype=np.uint64)]))
        a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, 9, dtype=np.uint64)])) for _ in range(2))
        assert len(both) / (len(a) + len(b) - len(both)) >= 0.8
        assert set(simhash_wide.prefix(a, known).tolist()) & set(simhash_wide.prefix(b, known).tolist())


def test_smallest_tables(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    got = {(x["doc_id"], x["component_id"]) for x in simhash_wide.linked(docs).collect()}
    assert got == {(d, o) for (d, _), o in zip(rows, owners(rows), strict=True)}
