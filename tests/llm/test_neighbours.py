"""The multi-index: order of the walk, exact scores, recall, and rows that take no part."""

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import multi_index


def test_walk():
    r = np.random.default_rng(0)
    for rows, columns in ((7, 9), (1, 5), (4, 1)):
        a, b = r.random(rows), r.random(columns)
        d = (a[:, None] + b).ravel()
        order = multi_index.walk(a, b, np.ones(rows * columns, int), rows * columns)
        assert sorted(order) == list(range(rows * columns)) and (np.diff(d[order]) >= 0).all()


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    got = multi_index.op9_multi_index(spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    place = {v: k for k, v in enumerate(ids)}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {int(v) for v in ids if v % 20 == 0}
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(r["vec_id"] != q for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        for r in rows:
            total = 0.0
            for x, y in zip(vectors[place[q]], vectors[place[r["vec_id"]]]):
                total += x * y
            assert r["score"] == total
        scores = vectors @ vectors[place[q]]
        scores[place[q]] = -9
        hits += len({r["vec_id"] for r in rows} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(by)


def test_odd_rows(spark):
    same = [1.0, 0.0, 0.5, 0.25]
    rows = [(i, same, "a") for i in range(100)] + [(200, [0.0] * 4, "a"), (220, None, "a"), (240, [1.0, None, 1.0, 1.0], "a"), (260, [float("nan")] * 4, "a"), (280, [float("inf"), 0.0, 0.0, 0.0], "a"), (300, [0.1, 0.2, 0.3, 0.4], None), (None, same, "a"), (300, [0.1, 0.2, 0.3, 0.4], "again")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in multi_index.search(table, share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 20, 40, 60, 80, 300}
    assert [v for _, v in sorted(got[20])] == [*range(20)] and [v for _, v in sorted(got[0])] == [*range(1, 21)]
    assert multi_index.search(table.limit(0)).count() == 0


def cloud(kind, n):
    r = np.random.default_rng(n)
    v = r.standard_normal((n, 64))
    if kind == "clusters":
        v = 0.15 * v + r.standard_normal((40, 64))[r.integers(0, 40, n)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v * r.lognormal(0, 0.5, n)[:, None] if kind == "uneven" else v


@pytest.mark.parametrize("kind,n", [("unit", 500), ("unit", 2000), ("unit", 50_000), ("uneven", 10_000), ("clusters", 20_000)])
def test_recall(spark, monkeypatch, kind, n):
    """Recall at 20 without structure, with uneven norms and in clusters; at these sizes in several blocks."""
    monkeypatch.setattr(multi_index, "BLOCK", 4096)
    v = cloud(kind, n)
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))}))
    got = multi_index.search(table, every=20 * max(1, n // 5000)).toPandas()
    asked = np.unique(got["query_id"].to_numpy())
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = {q: set(x) for q, x in zip(asked.tolist(), np.argsort(-scores, axis=1)[:, :20].tolist())}
    assert got.groupby("query_id").size().eq(20).all() and len(asked) == len(range(0, n, 20 * max(1, n // 5000)))
    recall = sum(len(best[q] & set(x)) for q, x in got.groupby("query_id")["vec_id"]) / 20 / len(asked)
    assert recall >= 0.9, recall
    print(kind, n, round(recall, 4))


def test_wide_and_narrow(spark):
    """One component, and more components than the sample's bound holds whole rows of."""
    r = np.random.default_rng(1)
    for dim in (1, 3, 40_000):
        v = r.standard_normal((60, dim))
        got = multi_index.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), share=1.0).toPandas()
        scores = v[::20] @ v.T
        scores[np.arange(3), np.arange(0, 60, 20)] = -np.inf
        assert [got[got.query_id == 20 * k].sort_values("rank")["vec_id"].tolist() for k in range(3)] == np.argsort(-scores, axis=1)[:, :20].tolist()
