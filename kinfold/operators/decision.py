"""Choosing a set per entity, and scoring the choice."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Matches beyond which the expectation carries no mass, and the least mass that counts.
SUPPORT, TINY = 16, 1e-12


def exclusive(rows: DataFrame) -> DataFrame:
    """Each candidate stays with its most probable entity, ties with the smaller one. A maximum, so it is combined before the shuffle
    however many entities claim a candidate."""
    rest = [c for c in rows.columns if c not in ("s1", "cand", "prob")]
    best = rows.groupBy("cand").agg(F.max(F.struct("prob", (-F.col("s1")).alias("_o"), *rest)).alias("_b"))
    return best.select("cand", (-F.col("_b._o")).alias("s1"), "_b.prob", *[f"_b.{c}" for c in rest]).select(rows.columns)


def threshold(rows: DataFrame, least: float) -> DataFrame:
    return rows.filter(F.col("prob") >= least)


def values(lists: list[np.ndarray], missed: float) -> list[np.ndarray]:
    """For each list of chances the expected F0.5 of choosing its first k, k from 0 on. Chances of 0 to SUPPORT matches are kept as
    running products from either end, for all lists at once; more matches and combinations below TINY are dropped."""
    n = max((len(x) for x in lists), default=0)
    p = np.zeros((len(lists), n))
    for k, x in enumerate(lists):
        p[k, : len(x)] = x
    inside, outside = np.zeros((n + 1, len(lists), SUPPORT + 1)), np.zeros((n + 1, len(lists), SUPPORT + 1))
    inside[0, :, 0] = outside[n, :, 0] = 1
    for k in range(n):
        for after, before, q in ((inside[k + 1], inside[k], p[:, k, None]), (outside[n - 1 - k], outside[n - k], p[:, n - 1 - k, None])):
            after[:] = before * (1 - q)
            after[:, 1:] += before[:, :-1] * q
    out, counts = np.zeros((n + 1, len(lists))), np.arange(SUPPORT + 1.0)
    out[0] = np.prod(1 - p, axis=1) if missed == 0 else 0.0
    for k in range(1, n + 1):
        a, b = inside[k, :, 1 : k + 1], outside[k, :, : n - k + 1]
        mass = a[:, :, None] * b[:, None, :]
        mass[(mass < TINY) | (a < TINY)[:, :, None]] = 0
        tp = counts[1 : a.shape[1] + 1, None]
        out[k] = np.einsum("xab,ab->x", mass, 1.25 * tp / (0.25 * (tp + counts[None, : b.shape[1]] + missed) + k))
    return [out[: len(x) + 1, k] for k, x in enumerate(lists)]


def expected_f(rows: DataFrame, missed: float = 0.0, most: int = 40, power: float = 1.0) -> DataFrame:
    """Per entity (s1, cand, prob) the prefix by prob of largest expected F0.5: s1, k, value, cands. Of equal values the shorter
    prefix wins. Only the most probable candidates up to most are considered, by the rule's own definition."""
    w = W.Window.partitionBy("s1").orderBy(F.desc("prob"), "cand")
    p = F.pow(F.least(F.greatest("prob", F.lit(0.0)), F.lit(1.0)), F.lit(power)) if power != 1 else F.least(F.greatest("prob", F.lit(0.0)), F.lit(1.0))
    top = rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most)
    per = top.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("_i", "cand", p.alias("p")))).alias("l"))  # at most most
    per = per.select("s1", F.transform("l", lambda x: x["p"]).alias("ps"), F.transform("l", lambda x: x["cand"]).alias("cs"))

    @F.pandas_udf("array<double>")
    def valued(ps: pd.Series) -> pd.Series:
        return pd.Series(values(list(ps), missed))

    each = F.transform(valued("ps"), lambda v, k: F.struct(F.round(v, 9).alias("v"), (-k).alias("k")))
    best = per.withColumn("_b", F.array_max(each))
    return best.select("s1", (-F.col("_b.k")).alias("k"), F.col("_b.v").alias("value"), F.slice("cs", F.lit(1), -F.col("_b.k")).alias("cands"))


def decided(rows: DataFrame, live: float = 0.01, missed: float = 0.0) -> DataFrame:
    """The rule that writes results: live pairs, one owner each, then the best prefix."""
    return expected_f(exclusive(rows.filter(F.col("prob") >= live)), missed)


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + b) * tp / (b * n_true + n_pred))


def counted(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """truth: s1, m (NULL for none); pred: s1, cand. Per entity of truth: n_true, n_pred, tp. Repeated pairs count once."""
    t = truth.groupBy("s1").agg(F.count_distinct("m").alias("n_true"))
    pairs = pred.select("s1", "cand").distinct()
    right = truth.filter("m IS NOT NULL").select("s1", F.col("m").alias("cand")).distinct().withColumn("ok", F.lit(1))
    got = pairs.join(right, ["s1", "cand"], "left").groupBy("s1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("ok").alias("tp"))
    return t.join(got, "s1", "left").select("s1", "n_true", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp"))


def scores(counts: DataFrame) -> DataFrame:
    tp, p, t = F.col("tp"), F.col("n_pred"), F.col("n_true")
    precision = F.when((p == 0) & (t == 0), 1.0).when(p == 0, 0.0).otherwise(tp / p)
    recall = F.when((p == 0) & (t == 0), 1.0).when(t == 0, 0.0).otherwise(tp / t)
    return counts.select("*", f_beta(tp, p, t).alias("f"), precision.alias("precision"), recall.alias("recall"))


def macro(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("f05"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def micro(counts: DataFrame) -> DataFrame:
    got = counts.agg(F.sum("tp").alias("tp"), (F.sum("n_pred") - F.sum("tp")).alias("fp"), (F.sum("n_true") - F.sum("tp")).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return got.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(1.25 * p * r / (0.25 * p + r), 6).alias("f05"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def unknown(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Entities that are predicted but unknown to truth."""
    return pred.select("s1").distinct().join(truth.select("s1").distinct(), "s1", "left_anti")


def strict(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """scores(), but an error if an entity is predicted that truth does not know."""
    if some := unknown(truth, pred).limit(5).collect():
        raise ValueError(f"entities without truth: {sorted(r['s1'] for r in some)}")
    return scores(counted(truth, pred))


def fold(column: str, n: int, salt: str = "") -> Column:
    """A stable fold of an entity, alike in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.col(column).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long") % n


def cross_validated(rows: DataFrame, n: int) -> DataFrame:
    """Per-fold macro scores, their mean and sample deviation."""
    folds = rows.groupBy(fold("s1", n).alias("fold")).agg(F.avg("f").alias("f"), F.count(F.lit(1)).alias("n"))
    all_ = folds.agg(F.avg("f").alias("m"), F.stddev_samp("f").alias("s"))
    return folds.crossJoin(F.broadcast(all_)).select("fold", "n", F.round("f", 6).alias("f05"), F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"))  # one row


def loss_budget(pairs: DataFrame, band: list[float]) -> DataFrame:
    """pairs: s1, cand, prob, label. Per probability band: pairs, wrong ones at one half, and the expected gain of judging them rightly."""
    edges = F.array(*[F.lit(b) for b in band])
    slot = F.size(F.filter(edges, lambda e: F.col("prob") >= e))
    wrong = ((F.col("prob") >= 0.5).cast("int") != F.col("label")).cast("int")
    n = W.Window.partitionBy("s1")
    return pairs.withColumn("share", wrong / F.count(F.lit(1)).over(n)).groupBy(slot.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_right"), F.sum(wrong).alias("n_wrong"), F.round(F.sum("share"), 6).alias("weighted_wrong"))


def fixed_gain(truth: DataFrame, pairs: DataFrame, least: float, band: list[float]) -> DataFrame:
    """Macro F0.5 of prob >= least, and what it would be if the pairs of each band of prob were all judged rightly. truth: s1, m;
    pairs: s1, cand, prob, label."""
    n = truth.groupBy("s1").agg(F.count("m").alias("n_true"))
    edges = F.array(*[F.lit(b) for b in band])
    slot = F.size(F.filter(edges, lambda e: F.col("prob") >= e))
    on = (F.col("prob") >= least).cast("int")
    per = pairs.withColumn("slot", slot).withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(len(band)))))
    said = F.when(F.col("b") == F.col("slot"), F.col("label")).otherwise(on)
    got = per.groupBy("b", "s1").agg(F.sum(said).alias("n_pred"), F.sum(said * F.col("label")).alias("tp"))
    every = n.withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(len(band))))).join(got, ["b", "s1"], "left").fillna(0)
    return every.groupBy("b").agg(F.round(F.avg(f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("f05"))


def bucket(n_true: Column) -> Column:
    return F.when(n_true == 0, "0").when(n_true == 1, "1").when(n_true <= 3, "2-3").when(n_true <= 6, "4-6").otherwise("7+")


def _listed(chosen: DataFrame) -> DataFrame:
    return chosen.select("s1", F.explode("cands").alias("cand"))


def rule_sweep(rows: DataFrame, thresholds: list[float], missed: list[float]) -> DataFrame:
    """Macro F0.5 of every rule: thresholds on prob, and the best expected prefix for so many missed matches an entity. rows: s1,
    cand, prob, label."""
    truth = rows.select("s1", F.when(F.col("label") == 1, F.col("cand")).alias("m"))
    rules = {f"thr{t}": rows.filter(F.col("prob") >= t).select("s1", "cand") for t in thresholds}
    rules |= {f"expected{m}": _listed(expected_f(rows.select("s1", "cand", "prob"), m)) for m in missed}
    parts = [macro(scores(counted(truth, chosen)), []).select(F.lit(name).alias("rule"), "n", "f05") for name, chosen in rules.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def entity_scores(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """F0.5 of every entity of truth (s1, m) under the rule that writes results; entities without a candidate count too."""
    return scores(counted(truth, _listed(decided(rows)))).select("s1", F.round("f", 6).alias("f05"))
