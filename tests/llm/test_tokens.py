"""Token files, packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import bpe_automaton, packing, segments, token_files

SCHEMA = "doc_id long, text string, start string, n_tokens string, sequence_id string"
LIBRARY = Tokenizer.from_file(segments.default_path())


def texts():
    r = random.Random(5)
    parts = [*" \n\t\r\x1c\x85　aé1'", "sts", "'ll", "  ", "<|endoftext|>", "漢", "%%%", "word.", "!!", "ß", "Ünd"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(300)] + ["", None, "a" * 3000, "x y " * 3000, "\n", " ", "-" * 2000]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "n", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    some = list(enumerate(texts()))
    return [*some, (3, "again"), (3, "again"), (None, "no id"), (None, None)]


def test_encoder():
    every = [t or "" for t in texts()]
    for text, got in zip(every, segments.library_encoder(segments.default_path()).render(every)):
        assert np.frombuffer(got, "<u4").tolist() == ids(text)
        assert "".join(segments.segments(text)) == text


def test_small_tables(monkeypatch):
    monkeypatch.setattr(segments, "KEPT", 5)
    monkeypatch.setattr(segments, "LONGEST", 3)
    encoder = segments.library_encoder(segments.default_path())
    for k in range(0, 300, 20):
        some = [t or "" for t in texts()[k : k + 20]]
        for text, got in zip(some, encoder.render(some)):
            assert np.frombuffer(got, "<u4").tolist() == ids(text)


def test_automaton(spark, rows):
    got = bpe_automaton.round_trip(frame(spark, rows)).collect()

    def want(text):
        i = ids(text)
        return len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(i, skip_special_tokens=False).encode()).hexdigest()

    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=key) == sorted(((i, *want(t)) for i, t in rows), key=key)


def test_gadgets():
    """The automaton of a few merges accepts what repeated merging leaves, on all words over three letters."""
    import itertools

    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "ab", "aa", "bc", "abc", "aab", "aaaa"])}
    merges = [("a", "b"), ("a", "a"), ("b", "c"), ("ab", "c"), ("a", "ab"), ("aa", "aa")]
    automaton = bpe_automaton.Automaton(vocabulary, merges)
    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            word = list(letters)
            for a, b in merges:
                k = 0
                while k + 1 < len(word):
                    if (word[k], word[k + 1]) == (a, b):
                        word[k : k + 2] = [a + b]
                    k += 1
            # merges apply by rank, and a later one can't make an earlier one's pair here
            assert automaton.encode("".join(letters).encode()) == [vocabulary[t] for t in word]


def test_random_merges():
    """Random merge lists, also with merges that can never occur, against merging by rank."""
    r = random.Random(8)
    for _ in range(60):
        made = list("abc")
        merges, vocabulary = [], {t: i for i, t in enumerate(made)}
        for _ in range(r.randrange(1, 14)):
            a, b = r.choice(made), r.choice(made)
            if a + b not in vocabulary and len(a + b) < 9:
                merges.append((a, b))
                vocabulary[a + b] = len(vocabulary)
                made.append(a + b)
        automaton = bpe_automaton.Automaton(vocabulary, merges)
        for _ in range(150):
            word = [r.choice("abc") for _ in range(r.randrange(1, 14))]
            whole = "".join(word)
            for a, b in merges:
                k = 0
                while k + 1 < len(word):
                    if (word[k], word[k + 1]) == (a, b):
                        word[k : k + 2] = [a + b]
                    k += 1
            assert automaton.encode(whole.encode()) == [vocabulary[t] for t in word], (merges, whole)
            assert automaton.decode([vocabulary[t] for t in word]) == whole.encode()


def test_token_files(spark, rows, tmp_path):
    manifest = token_files.write(frame(spark, rows), f"file://{tmp_path}/ids")
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (i, t) in zip(got, ordered, strict=True):
        whole = [*ids(t), token_files.END_ID]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, at, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()))
        at += len(whole)


def test_packing(spark, rows):
    pieces = packing.pack(frame(spark, rows), window=64).collect()
    by, seen = {}, {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for parts in by.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 64
    assert sum(sum(p["length"] for p in parts) < 64 for parts in by.values()) <= 4  # one a task
    for i in {i for i, _ in rows if i not in (None, 3)}:
        whole = [*ids(dict(rows)[i]), packing.END_ID]
        at = 0
        for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(whole)
            assert p["ids_crc32"] == zlib.crc32(np.array(whole[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(whole)
        seen[i] = at
    assert sum(p["length"] for p in pieces) == sum(len(ids(t)) + 1 for _, t in rows)


def test_sum_of_squares():
    """The chosen level is the best one by trying all."""
    r = random.Random(2)
    packer = packing.Packer(16)
    for k in range(400):
        n = r.randrange(1, 17)
        counts = packer.levels.copy()

        def after(fill):
            c = counts.copy()
            if fill:
                c[fill] -= 1
            if fill + n < 16:
                c[fill + n] += 1
            return int((c[1:16] ** 2).sum())

        options = [f for f in range(16 - n + 1) if f == 0 or counts[f]]
        best = min(after(f) for f in options)
        assert packer.choose(n) == max(f for f in options if after(f) == best)
        packer.place((k, 0, list(range(n))))


def test_empty(spark, tmp_path):
    none = frame(spark, [])
    assert bpe_automaton.round_trip(none).count() == packing.pack(none).count() == 0
    assert token_files.read(token_files.write(none, f"file://{tmp_path}/none")).count() == 0
    assert none.filter(F.col("doc_id") > 0).count() == 0
