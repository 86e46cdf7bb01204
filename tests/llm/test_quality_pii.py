"""The quality classifier by held-out labels, personal data by a plain version of the base patterns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import pii, quality

FOLDER = "/root/testdata/sf0.01"


def test_quality_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs.select("doc_id", "text")).join(labels, "doc_id").select("quality", "keep").collect()
    good, bad = [r["keep"] for r in got if r["quality"] == 1], [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_quality_cases(spark):
    clean = "The old house stands near the river, and nobody lives there. In spring the garden is full of birds."
    rows = [(i, clean, "x") for i in range(60)] + [(100 + i, " ".join(w + "%%%" for w in clean.split()), "x") for i in range(20)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in clean.split()), "x") for i in range(20)] + [(300, None, "x"), (301, "", "x"), (None, clean, "x"), (302, clean * 2000, "x"), (303, "same " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r["doc_id"]: r["keep"] for r in quality.judged(docs).collect()}
    assert all(got[i] for i in range(60)) and got[None] and got[302]
    assert not any(got[i] for i in [*range(100, 120), *range(200, 220), 300, 301, 303])
    assert quality.judged(docs.limit(0)).count() == 0
    kept = quality.kept(docs.drop("score"))
    assert kept.columns == ["doc_id", "text"] and kept.count() == 62


def plain_votes(text):
    """What the labelers say, word by word."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    raw = [w.encode() for w in ws]
    n = max(1, len(ws))
    lower, upper, digit, mark = (lambda c: 97 <= c <= 122 or c >= 128), (lambda c: 65 <= c <= 90), (lambda c: 48 <= c <= 57), (lambda c: c in b".,;:?'\"()-")
    spoken = lambda c: lower(c) or upper(c) or digit(c)
    data = text.encode()
    symbols = sum(c in b"#$%&*~^<>{}[]\\|!" for c in data) / n
    plain = sum(map(spoken, data)) / max(1, sum(map(len, raw)))
    loud = sum(map(upper, data)) / max(1, sum(lower(c) or upper(c) for c in data))
    doubled = sum(len(w) > 1 and not spoken(w[-1]) and not spoken(w[-2]) for w in raw) / n
    lone = sum(not any(map(spoken, w)) for w in raw) / n
    again = sum(a == b for a, b in zip(raw, raw[1:])) / n
    ends = sum(mark(w[-1]) and len(w) > 1 and spoken(w[-2]) for w in raw) / n
    variety, few, some = len(set(raw)) / n, len(ws) < 4, len(ws) >= 30
    rules = [
        (symbols > 0.25, symbols < 0.05),
        (plain < 0.8 and not few, plain > 0.9 or few),
        (loud > 0.3 and not few, loud < 0.15 or few),
        (doubled > 0.25, doubled < 0.08),
        (lone > 0.1, lone < 0.03),
        (again > 0.15 and not few, again < 0.05),
        (some and variety < 0.15, some and variety > 0.3),
        (len(ws) >= 50 and ends < 0.005, ends > 0.02),
    ]
    return [0 if bad else 2 if good else 1 for bad, good in rules]


def test_quality_brute_force(spark):
    """The whole query on the smallest tables, and odd texts, against votes, estimates, training and scores worked out plainly."""
    import pyarrow as pa
    import xxhash

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    odd = ["", " ", "a", "A B C D", "| | |", "é! ??", "x x x x x", "1234 " * 60, "«»"]
    votes = {i: plain_votes(t) for i, t in enumerate([*texts.values(), *odd])}
    got = quality.Documents(pa.array([*texts.values(), *odd])).patterns().tolist()
    assert [quality._votes(p) for p in got] == [votes[i] for i in range(len(got))]
    counts = {}
    for t in texts.values():
        p = int("".join(map(str, plain_votes(t))), 3)
        counts[p] = counts.get(p, 0) + 1
    posterior, _ = quality.estimate(counts)
    # all different texts are in the sample, in the order of Spark's hash
    order = spark.createDataFrame([(i, t) for i, t in texts.items()], "i long, t string").select("i", F.xxhash64("t").alias("h"), F.pmod(F.xxhash64("t"), F.lit(1 << 30)).alias("p")).collect()
    firsts = {}
    for r in order:
        firsts.setdefault(r["h"], r["i"])
    chosen = [texts[firsts[h]] for h in sorted(firsts)]
    d = quality.Documents(pa.array(chosen))
    rows, shares = [], []
    for k, t in enumerate(chosen):
        own = d.words.doc == k
        index, times = np.unique(np.concatenate([d.features[0][own], d.features[1][own]]), return_counts=True)
        rows.append(index)
        shares.append((times / max(1, own.sum())).astype(np.float32).astype(float))
    weights, bias = quality.train(rows, shares, np.array([posterior[int("".join(map(str, plain_votes(t))), 3)] for t in chosen]))
    for r in quality.op1_quality(spark, "/root/testdata/sf0.001").collect():
        one = quality.Documents(pa.array([texts[r["doc_id"]]]))
        n = len(one.hash)
        score = bias + sum(weights[f] for f in [*one.features[0], *one.features[1]]) / n if n else float("-inf")
        assert abs(r["score"] - score) < 1e-4 or r["score"] == score
        assert r["keep"] == int(score >= 0)


def test_quality_repeated_rows(spark):
    """Very many copies of one text leave a sample, wherever its hash lies: junk goes and prose stays."""
    for text, keep in [("&&& *** " * 9, False), ("A%% B## C&& D$$ E** F!! " * 8, False), ("The old house stands near the river, and nobody lives there now.", True)]:
        rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
        assert quality.judged(rows).filter("keep").count() == (40_000 if keep else 0)
    model = quality.fit(rows, 10, 3)
    assert model[0].any() or model[1]


def test_quality_estimate():
    """Votes drawn from known labelers give back the truth's side."""
    r = random.Random(6)
    counts, truth = {}, {}
    for _ in range(5000):
        good = r.random() < 0.8
        p = 0
        for k in range(len(quality.LABELERS)):
            v = (r.choices((0, 1, 2), (0.02, 0.38, 0.6)) if good else r.choices((0, 1, 2), (0.5, 0.4, 0.1)))[0]
            p = p * 3 + v
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    posterior, learned = quality.estimate(counts, false=1.0, blind=0.0)
    right = sum(g == (posterior[p] >= 0.5) for p, gs in truth.items() for g in gs)
    assert right > 4900 and all(abs(a[2] - 0.6) < 0.08 for a, _ in learned.values())


def test_quality_one_fault_each():
    """Bad documents have one fault of four, of very different frequency, which two labelers see."""
    r = random.Random(9)
    counts, truth = {}, {}
    for _ in range(20_000):
        fault = r.choices((None, 0, 1, 2, 3), (0.86, 0.09, 0.03, 0.01, 0.01))[0]
        votes = [(0 if r.random() < 0.95 else 1) if fault is not None and k // 2 == fault else r.choices((0, 1, 2), (0.001, 0.049, 0.95))[0] for k in range(8)]
        p = int("".join(map(str, votes)), 3)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(fault is None)
    posterior, _ = quality.estimate(counts)
    wrong = sum(g != (posterior[p] >= 0.5) for p, gs in truth.items() for g in gs)
    assert wrong < 200


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(f"card:{m.start()}:{m.end()}")
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(out)


def test_base(spark):
    r = random.Random(3)
    parts = ["a", "@", ".", "1", "23", "255", "256", "0", "-", " ", "+", "(", ")", "é", "漢😀", "x.y", "\n", "4111111111111111", "00", "%", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(45))) for _ in range(1500)]
    texts += ["", "9" * 20_000, "a" * 50_000, "1 " * 5_000, "1." * 5_000, "a@b.c" * 500, "+1" + "(" * 20_000, "0001.002.03.4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows.select("doc_id", pii.listed(F.concat(*pii.base_spans(F.col("text")).values())).alias("x"))
    for row in found.collect():
        assert row["x"] == base(texts[row["doc_id"]])


def test_whole_table(spark):
    """Base spans on a whole table, and every planted secret among the added ones."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    added = 0
    for r in pii.op4_pii(spark, FOLDER).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
        added += r["spans"].count("secret:")
    assert added == sum(t.count('token = "') for t in texts.values())


def test_pii_cases(spark):
    rows = [(1, 'token = "0123456789abcdef0123456789abcdef01234567" and a@b.cd', "k"), (1, "a@b.cd a@b.cd", "k"), (2, None, "k"), (None, "+1 (555) 555-0100", "k"), (3, "plain words " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.with_spans(docs).select("doc_id", "kind", pii.listed(F.col("_spans")).alias("s"), pii.redacted(F.coalesce("text", F.lit("")), F.col("_spans")).alias("t")).collect()
    texts = [r["t"] for r in got]
    assert any("[EMAIL] [EMAIL]" in t for t in texts) and "[PHONE]" in texts and "plain words " * 5000 in texts and "" in texts
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_many_spans(spark):
    """Thousands of spans in one text, over several blocks, in little time."""
    import time

    n = 32_000
    text = " ".join(f"a{i}@b{i}.cd" for i in range(n))
    docs = spark.createDataFrame([(1, text, "x"), (2, "c@d.ef " * 300 + "end", "x")], "doc_id long, text string, _rest string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.with_spans(docs).select("doc_id", pii.listed(F.col("_base")).alias("s"), pii.redacted(F.col("text"), F.col("_spans")).alias("t")).collect()}
    assert time.time() - began < 40
    assert got[1]["s"] == base(text) and got[1]["t"] == " ".join(["[EMAIL]"] * n) and got[2]["t"] == "[EMAIL] " * 300 + "end"


def test_context_of_matches(spark):
    """What stands around a match, beside the start and end of the text and other matches."""
    text = "id 123-45-6789 ssn: 111-22-3333,222-33-4444"
    row = spark.createDataFrame([(text,)], "text string").select(pii.found(F.col("text"), pii.SSN, "ssn", F.lit(True)).alias("x")).first()["x"]
    assert [(r["match"], text[r["start"] : r["end"]], r["before"], r["after"]) for r in row] == [("123-45-6789", "123-45-6789", "id ", " "), ("111-22-3333", "111-22-3333", text[max(0, 20 - 32) : 20][-17:], ","), ("222-33-4444", "222-33-4444", "111-22-3333,", "")]


def test_redacted_overlaps(spark):
    """Against a plain version, on random spans that overlap and repeat."""
    r = random.Random(5)
    rows = []
    for i in range(200):
        text = "".join(r.choice("abé漢😀 ") for _ in range(r.randrange(1, 400)))
        spans = []
        for _ in range(r.randrange(300)):
            a = r.randrange(len(text))
            spans.append((r.choice(["email", "ip"]), a, min(len(text), a + r.randrange(1, 5))))
        rows.append((i, text, spans))
    docs = spark.createDataFrame(rows, f"i long, text string, spans {pii.SPAN}")
    for row in docs.select("i", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect():
        _, text, spans = rows[row["i"]]
        out, at = "", 0
        for a, back, kind in sorted((s, -e, k) for k, s, e in spans):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, -back)
        assert row["t"] == out + text[at:]


@pytest.mark.parametrize("true", [0.2, 0.7])
def test_pii_estimate(true):
    r = random.Random(1)
    cells, truth = {}, {}
    for _ in range(4000):
        t = r.random() < true
        cell = "sec" + "".join(str(r.choices((0, 1, 2), (0.05, 0.25, 0.7) if t else (0.7, 0.25, 0.05))[0]) for _ in pii.LABELERS)
        cells[cell] = cells.get(cell, 0) + 1
        truth.setdefault(cell, []).append(t)
    share, _, posterior = pii.estimate(cells)
    weights = pii.train(cells, posterior)
    right = sum(t == (sum(weights[s] for s in pii.signals(c)) > 0) for c, ts in truth.items() for t in ts)
    assert abs(share - true) < 0.05 and right > 3850
