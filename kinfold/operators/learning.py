"""Learned scorers on pyspark.ml: a cascade that prunes pairs, out-of-fold scores, a second stage on them."""

from __future__ import annotations

import functools

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.sources import records as R

from .decision import fold

#: Features are cut into at most so many bins, by these many evenly spaced quantiles of all pairs; so many features fit one number.
BINS, BITS, GRID, ACCURACY, PACKED = 32, 5, 1024, 4096, 12
#: A training task has about so many rows.
TASK_ROWS = 100_000


def _splits(values: list[float]) -> list[float]:
    """Where bins begin: at each of values, which are evenly spaced quantiles, if these are few, else at BINS quantiles."""
    few = sorted(set(values))
    if len(few) > BINS:
        few = sorted(set(values[:: GRID // BINS][:-1]))
    return [-float("inf"), *(few[1:] or few), float("inf")]


def binned(rows: DataFrame, features: list[str]) -> PipelineModel:
    """From features (missing ones are -1) to the numbers of their bins, as a vector: at most BINS bins each, by quantiles of all rows."""
    share = [F.percentile_approx(F.col(f"`{c}`").cast("double"), [k / GRID for k in range(GRID + 1)], ACCURACY) for c in features]
    values = rows.fillna(-1.0, features).agg(*share).first()
    cut = Bucketizer(splitsArray=[_splits(v) if v else [-float("inf"), 0.0, float("inf")] for v in values], inputCols=features, outputCols=_names(features))
    return PipelineModel([cut, VectorAssembler(inputCols=cut.getOutputCols(), outputCol="x")])


def tallied(rows: DataFrame, features: list[str], bins: PipelineModel, *by: str) -> tuple[DataFrame, str]:
    """Training rows as trees see them: one a label, values of by and bins of all features, with n, the number of pairs; and where they
    are written. Label and by are whole numbers under BINS - 1, a missing one becomes that. PACKED of all travel as one number."""
    digits = [*_names(features), "label", *by]
    keys = [f"_k{k}" for k in range(-(-len(digits) // PACKED))]

    def packed(some: list[str]) -> Column:
        return functools.reduce(Column.bitwiseOR, [F.shiftleft(F.coalesce(F.col(c).cast("long"), F.lit(BINS - 1)), BITS * i) for i, c in enumerate(some)])

    def digit(k: int) -> Column:
        return F.shiftright(keys[k // PACKED], BITS * (k % PACKED)).bitwiseAND(F.lit(BINS - 1)).cast("double").alias(digits[k])

    numbered = bins.stages[0].transform(rows.fillna(-1.0, features))
    numbered = numbered.select(*[packed(digits[k * PACKED : (k + 1) * PACKED]).alias(c) for k, c in enumerate(keys)])
    got, path = R.cut(numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "tally")
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), got.count() // TASK_ROWS + 1)
    got = got.repartition(tasks, *keys).sortWithinPartitions(*keys)  # models see the same order each time
    return bins.stages[1].transform(got.select("n", *map(digit, range(len(digits))))), path


def fitted(rows: DataFrame, features: list[str], trees: int = 12, depth: int = 4) -> PipelineModel:
    """Boosted trees over binned features. Pairs that are equal there are one row of training, with their number as weight."""
    bins = binned(rows, features)
    data, path = tallied(rows, features, bins)
    model = _boosted(data.withColumn("weight", F.col("n").cast("double")), trees, depth)
    R.forget(rows.sparkSession, path)
    return PipelineModel([*bins.stages, model])


def _boosted(data: DataFrame, trees: int = 12, depth: int = 4):
    return GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxBins=BINS, maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(data)


def _scored(model, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, F.round(vector_to_array("probability")[1], 6)).drop("rawPrediction", "probability", "prediction")


def _names(features: list[str]) -> list[str]:
    return [f"_b{k}" for k in range(len(features))]


def applied(model: PipelineModel, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    return _scored(model, rows.fillna(-1.0, features), name).drop("x", *_names(features))


def _fold_models(rows: DataFrame, features: list[str], folds: int, share: float) -> tuple[PipelineModel, list, DataFrame, str]:
    """Bins, a model a fold that has not seen the labels of its entities, the training rows of all folds, and where they are written.
    Of pairs that are not right, models learn from a hash-chosen share, with weight 1 / share."""
    bins = binned(rows, features)
    chosen = (F.col("label") == 1) | (fold("cand", 1_000_003, "s") < share * 1_000_003)
    data, path = tallied(rows.withColumns({"_fold": fold("s1", folds), "_in": chosen.cast("int")}), features, bins, "_fold", "_in")
    weight = F.col("n") * F.when(F.col("label") == 1, 1.0).otherwise(1 / share)
    models = [_boosted(data.filter((F.col("_fold") != k) & (F.col("_fold") < folds) & (F.col("_in") == 1)).withColumn("weight", weight)) for k in range(folds)]
    return bins, models, data, path


def _folded(models: list, rows: DataFrame, own) -> DataFrame:
    """p for each row with a vector x by the model of its fold."""
    return functools.reduce(DataFrame.unionByName, [_scored(m, rows.filter(own == k), "p") for k, m in enumerate(models)])


def out_of_fold(rows: DataFrame, features: list[str], folds: int = 3, share: float = 1.0) -> DataFrame:
    """Scores of models that have not seen the labels of the pair's entity."""
    bins, models, _, path = _fold_models(rows, features, folds, share)
    R.forget(rows.sparkSession, path)
    return _folded(models, bins.transform(rows.fillna(-1.0, features)), fold("s1", folds)).drop("x", *_names(features))


def stacked(rows: DataFrame, features: list[str], folds: int = 3, share: float = 1.0) -> DataFrame:
    """out_of_fold, and p2 of a second stage, which sees the first one's logit beside its features and learns from all pairs."""
    bins, models, data, path = _fold_models(rows, features, folds, share)
    seen = _folded(models, data, F.col("_fold")).withColumn("_l", logit(F.col("p")))
    values = seen.agg(F.percentile("_l", [k / GRID for k in range(GRID + 1)], F.col("n"))).first()[0]
    more = PipelineModel([Bucketizer(splits=_splits(values), inputCol="_l", outputCol="_bl"), VectorAssembler(inputCols=["x", "_bl"], outputCol="x2")])
    second = _boosted(more.transform(seen).drop("x").withColumnRenamed("x2", "x").withColumn("weight", F.col("n").cast("double")))
    R.forget(rows.sparkSession, path)
    got = _folded(models, bins.transform(rows.fillna(-1.0, features)), fold("s1", folds)).withColumn("_l", logit(F.col("p")))
    return _scored(second, more.transform(got).drop("x").withColumnRenamed("x2", "x"), "p2").drop("x", "_l", "_bl", *_names(features))


def cascade(rows: DataFrame, features: list[str], least: float = 1e-3) -> DataFrame:
    """The pairs that a cheap model does not rule out, with its score p."""
    return out_of_fold(rows, features).filter(F.col("p") >= least)


def logit(p):
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.log(q / (1 - q))


def shifted(p, by):
    """A probability moved in logit space."""
    return 1 / (1 + F.exp(-(logit(p) + by)))


def prune_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold on prob: the share of pairs kept and of right pairs kept."""
    each = rows.select("prob", "label", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr"))
    on = (F.col("prob") >= F.col("thr")).cast("int")
    return each.groupBy("thr").agg(F.round(F.avg(on), 6).alias("kept"), F.round(F.sum(on * F.col("label")) / F.sum("label"), 6).alias("recall"))


def banded(rows: DataFrame, low: float, high: float, easy: float) -> DataFrame:
    """Training pairs: all of the undecided band and a hash-chosen share of the others."""
    inside = F.col("prob").between(low, high)
    return rows.filter(inside | (fold("cand", 1_000, "band") < easy * 1_000))


def uniform(entities: DataFrame, n: int, seed: str = "u") -> DataFrame:
    """n entities without replacement, the same ones on every run."""
    return entities.orderBy(F.md5(F.concat(F.col("s1").cast("string"), F.lit(seed))), "s1").limit(n)


def self_trained(rows: DataFrame, features: list[str], unseen, rounds: int = 2, sure: float = 0.98, unsure: float = 0.02) -> DataFrame:
    """Scores for the pairs where unseen holds: the labelled pairs train a model, its sure answers there train the next."""
    known, other = rows.filter(~unseen), rows.filter(unseen).drop("label")
    scored = applied(fitted(known, features), other, features)
    for _ in range(rounds):
        pseudo = scored.filter((F.col("p") >= sure) | (F.col("p") <= unsure)).withColumn("label", (F.col("p") >= sure).cast("int")).select(known.columns)
        scored = applied(fitted(known.unionByName(pseudo), features), other, features)
    return scored
