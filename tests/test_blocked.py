"""The blocked search against plain sums, and what it adds up on the way."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinfold import catalog
from kinfold.operators import blocked

FOLDER = "/root/testdata/sf0.001"


def group(pool, asked, weights):
    """pool and asked: terms by code."""
    kinds = [blocked.WEIGHT] + [blocked.POOL] * len(pool) + [blocked.QUERY] * len(asked)
    return pa.table({
        "kind": pa.array(kinds, pa.int32()),
        "code": pa.array([None, *pool, *asked], pa.int64()),
        "terms": pa.array([list(weights), *pool.values(), *asked.values()], pa.list_(pa.string())),
        "w": pa.array([list(weights.values()), *[None] * (len(pool) + len(asked))], pa.list_(pa.float64())),
    })


def plain(pool, asked, weights, k):
    def square(terms):
        return sum(weights[t] ** 2 for t in sorted(terms) if t in weights)

    out = []
    for s1, q in asked.items():
        met = [(-round(square(set(q) & set(p)) / (square(q) * square(p)) ** 0.5, 9), cand) for cand, p in pool.items() if any(t in weights for t in set(q) & set(p))]
        out += [(s1, cand, -value) for value, cand in sorted(met)[:k]]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_best_is_the_plain_search(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice([3, 20, 200]))]
    weights, k = {w: 1 + i % 5 + r.choice([0.0, 0.5]) for i, w in enumerate(words)}, r.choice([1, 3, 10])

    def terms():
        return r.sample(words, r.randint(1, min(len(words), 8))) + r.choice([[], ["unknown"]])

    pool = {k: terms() for k in r.sample(range(10_000), r.choice([2, 50, 900]))}
    pool |= {c + 20_000: list(p) for c, p in pool.items() if c % 3 == 0}
    asked = {50_000 + i: r.choice(list(pool.values())) if i % 4 == 0 else terms() for i in range(60)} | {60_000: ["unknown"], 60_001: []}
    s1, cand, value = blocked.best(group(pool, asked, weights), k)
    got = sorted(zip(s1.tolist(), cand.tolist(), value.tolist(), strict=True))
    want = sorted(plain(pool, asked, weights, k))
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1.5e-9)


@pytest.mark.parametrize("copies, common", [(30, 0), (1, 40)])
def test_neither_copies_nor_frequent_terms_are_added_up_one_by_one(monkeypatch, copies, common):
    """200 queries and 600 records that share 40 terms each, or 30 copies of each of 20 records and 6 queries, which share one."""
    often = [f"c{i}" for i in range(common or 1)]
    pool = {i: [*often, f"p{i // copies}"] for i in range(600)}
    asked = {1_000 + i: [*often, f"p{i // copies}"] for i in range(200)}
    added = []
    real = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: added.append(len(x)) or real(x, *a, **b))
    s1, _, _ = blocked.best(group(pool, asked, {t: 2.0 for p in pool.values() for t in p}), 5)
    assert len(s1) == 1_000 and sum(added) < 40_000  # 200 * 600 pairs share a term or 40


@pytest.mark.parametrize("name", ["jn_caddr_topk", "jn_char3_topk", "jn_anti_new", "agg_union_recall"])
def test_trigrams_are_made_once(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "terms" in plan and not any(f in plan for f in ("flatten", "regexp_extract_all", "substring(concat"))


def test_frequent_pruned_terms_are_not_sent(spark):
    plan = catalog.QUERIES["jn_name_topk"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except") == 2
