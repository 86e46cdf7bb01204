"""Substring dedup, SimHash and components against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from kinfold.llm import components, simhash, substring, words

SCHEMA = "doc_id long, text string, chunk string, n_words string, f string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(60)] + ["a", "b"]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(80):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))]
        if r.random() < 0.4:
            parts.insert(r.randrange(2), passage)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(90, rows[5][1]), (91, rows[5][1]), (200, "a " * 500), (201, "a " * 400), (7, rows[7][1]), (300, None), (301, ""), (None, passage), (None, None), (302, "x" * 5000), (303, " \x0b\x0c ")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", "n", "f") for i, t in rows], SCHEMA)


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_substring(spark):
    rows = corpus()
    starts = {}
    big = 1 << 70
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - 12):
            s = tuple(ws[k : k + 13])
            starts[s] = min(starts.get(s, big), big if i is None else i)
    want = []
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - 12):
            if starts[tuple(ws[k : k + 13])] < (big if i is None else i):
                gone |= set(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        want.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.repeats(frame(spark, rows), text="clean").collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert sum(b - a for a, b in r["intervals"]) == r["n_removed"]
        if not r["n_removed"]:
            assert r["clean"] == r["text"]
        assert hashlib.sha256(" ".join(WORD.findall(r["clean"] or "")).encode()).hexdigest() == r["kept_sha256"]
        assert r["chunk"] == "c"
    assert substring.repeats(frame(spark, [])).count() == 0


def test_colliding_words(spark):
    """Words that any polynomial hash modulo 2^64 takes for one, and a window hash that is cut to a few bits."""
    thue = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{thue} {rest}"), (2, f"{other} {rest}"), (3, f"{thue} {rest}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    long = "x" * (words.SLICE + 5)
    import pyarrow as pa

    h = words.Words(pa.array([f"{long} {long}y {long}", long])).hashes()
    assert h[0] == h[2] == h[3] != h[1]
    order, fresh = substring.grouped(np.array([5, 3, 5, 5], np.uint64), np.array([1, 0, 0, 1], np.uint16))
    assert order.tolist() == [1, 2, 0, 3] and fresh.tolist() == [True, True, True, False]


def test_windows_by_hand():
    import pyarrow as pa

    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "é"]) for _ in range(r.randrange(30))) for _ in range(60)]
    at, keys, checks = words.Words(pa.array(texts)).windows(4)
    runs = [tuple(t.split()[k : k + 4]) for t in texts for k in range(len(t.split()) - 3)]
    assert len(at) == len(runs) and keys.max() < 1 << 62
    seen = {}
    for run, h in zip(runs, zip(keys.tolist(), checks.tolist())):
        assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


def test_one_id_many_chunks(spark, monkeypatch):
    """Rows of null and of equal doc_id are dealt to several chunks and still leave each other alone."""
    monkeypatch.setattr(substring, "CHUNK_BYTES", 200)
    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(None, f"n{i} {passage}") for i in range(60)] + [(5, f"f{i} {passage}") for i in range(60)] + [(k, " ".join(f"u{k}x{j}" for j in range(20))) for k in range(10, 50)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = substring.dealt(docs, 40).groupBy("doc_id").agg(F.count_distinct(substring.ADDED).alias("n")).collect()
    assert {x["doc_id"]: x["n"] > 3 for x in chunks if x["doc_id"] in (None, 5)} == {None: True, 5: True}
    for x in substring.repeats(docs).collect():
        assert x["n_removed"] == (20 if x["doc_id"] is None else 0)


def test_packed():
    r = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 61):
        h = np.unique(r.integers(0, top, 500, dtype=np.uint64))
        checks = r.integers(0, 1 << 16, len(h)).astype(np.uint16)
        got = substring.unpacked(substring.packed(h, checks))
        assert (got[0] == h).all() and (got[1] == checks).all()


def test_word_hashes():
    import pyarrow as pa

    r = random.Random(9)
    some = ["".join(r.choice("ab é\n\x00") for _ in range(r.randrange(40))) for _ in range(200)]
    w = words.Words(pa.array([*some, None, ""]).slice(3))
    found = [raw for t in [*some, "", ""][3:] for raw in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == found
    seen = {}
    for raw, h in zip(found, w.hashes().tolist()):
        assert seen.setdefault(raw, h) == h
    assert len(set(seen.values())) == len(seen)


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]), 42) for k in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, least):
    """Smallest member's least of each value's group, linked at four or fewer bits."""
    u = np.array(values, np.uint64)
    parent = list(range(len(u)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[:i]) <= 4):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    best = {}
    for i, v in enumerate(least):
        if v is not None:
            best[root(i)] = min(best.get(root(i), v), v)
    return [best.get(root(i)) for i in range(len(u))]


def test_simhash(spark):
    rows = corpus()
    long = " ".join(f"k{i}" for i in range(400))
    rows += [(400, long), (401, long + " end"), (402, long.upper()), (403, long.replace("k7 ", "kx "))]
    marks = [plain_fingerprint(t) for _, t in rows]
    owner = groups(marks, [i for i, _ in rows])
    got = simhash.linked(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(((i, f"{m:016x}", o) for (i, _), m, o in zip(rows, marks, owner)), key=key)
    assert simhash.linked(frame(spark, [])).count() == 0


def test_dense_ball(spark):
    """Thousands of fingerprints around a few centres, chained and apart."""
    r = np.random.default_rng(3)
    found = set()
    for centre in r.integers(0, 1 << 63, 2, dtype=np.uint64).tolist():
        for _ in range(500):
            v = centre
            for b in r.choice(64, r.integers(0, 9), replace=False).tolist():
                v ^= 1 << b
            found.add(v)
    values = sorted(found | set(r.integers(0, 1 << 63, 300, dtype=np.uint64).tolist()))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    got = {x["f"]: x["root"] for x in simhash.classes(spark.createDataFrame([(v,) for v in signed], "f long"))[0].collect()}
    assert [got[v] for v in signed] == groups(values, signed)


def test_crowded_key(spark, monkeypatch):
    """Fingerprints that agree in the first 26 bits, so that all share a key, and lie in pairs four bits apart."""
    monkeypatch.setattr(simhash, "FINE", 16)
    r = np.random.default_rng(5)
    values = set()
    for _ in range(150):
        v = int(r.integers(0, 1 << 38)) << 26
        values.add(v)
        values.add(v ^ sum(1 << int(b) for b in r.choice(np.arange(26, 64), 4, replace=False)))
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    found, _ = simhash.classes(spark.createDataFrame([(v,) for v in signed], "f long"))
    got = {x["f"]: x["root"] for x in found.collect()}
    assert [got[v] for v in signed] == groups(values, signed)


def test_hot_keys(spark, monkeypatch):
    """Most rows are one text, and one component holds most fingerprints: the rows that are joined by broadcast."""
    from kinfold.llm import common

    monkeypatch.setattr(common, "LEAST", 3)
    line = " ".join(f"k{i}" for i in range(300))
    rows = [(i, "same text") for i in range(60)] + [(100 + i, f"{line} end{i}") for i in range(40)] + [(200 + i, f"own{i} words{i}") for i in range(20)]
    marks = [plain_fingerprint(t) for _, t in rows]
    want = groups(marks, [i for i, _ in rows])
    got = simhash.linked(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, o) for (i, _), o in zip(rows, want))


def test_leaf_bytes(spark):
    """A join's size estimate is a product; what is counted is what is read."""
    from kinfold.llm import common

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    once = common.input_bytes(docs)
    joined = docs.select("doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    assert once < common.input_bytes(joined) <= 3 * once and common.piece_count(joined, 2 << 20) == 8
    assert 0 < common.input_bytes(spark.createDataFrame(docs.limit(5).rdd, docs.schema)) < 1 << 20


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {a: b for a, b in root.items() if a != b}
