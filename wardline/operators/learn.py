"""Training and combining of models with Spark ML.

Folds and splits follow a hash of the row, so they are the same at every run and need no order. Boosted trees and
forests stand for the boosting libraries' learners; they play the same part without reproducing their numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from random import Random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators import metrics

#: What the model of a fold sees of rows.
View = Callable[[DataFrame, int], DataFrame]
#: Rows of a class, about, that a task puts in order when folds are dealt.
DEALT = 1000
#: Stands for a missing value in trees.
SENTINEL = -999.0


@dataclass
class Learner:
    """A way to fit: 'logistic', 'boosted' or 'forest', with its parameters; boosting stops early where rows are set
    aside for that."""

    kind: str
    rounds: int = 20
    depth: int = 5
    rate: float = 0.1
    penalty: float = 0.01
    seed: int = 42


def sample_weights(y, weak, positive: float = 3.0, weak_negative: float = 0.25):
    """Weight of a row: positive ones and weak negatives have their own, others 1, unlabelled ones null."""
    return F.when(y == 1, positive).when(y == 0, 1.0).when(weak, weak_negative)


def _small(ident: str):
    """A row's number folded, so that products of it cannot overflow."""
    return F.pmod(F.col(ident), F.lit(10**9 + 7))


def hash_split(df: DataFrame, ident: str, share_percent: int = 20) -> DataFrame:
    """df with is_validation, by the rest of the row's number after division by 100 of its hundredfold prime."""
    return df.withColumn("is_validation", (F.pmod(_small(ident) * 7919, F.lit(100)) < share_percent).cast("int"))


def stratified_folds(df: DataFrame, ident: str, y: str = "y", folds: int = 5) -> DataFrame:
    """df with fold 0 to folds - 1, each class spread evenly in the order of a multiplicative hash of the row's number.

    Rows are dealt within blocks of a hash, as many as it takes for about DEALT rows each, so that no task orders a whole
    class; blocks start at different folds.
    """
    block = F.pmod(_small(ident) * 7919, F.lit(max(64, df.count() // DEALT)))
    order = W.partitionBy(y, block).orderBy(F.pmod(_small(ident) * 104729, F.lit(1000003)), ident)
    return df.withColumn("fold", F.pmod(F.row_number().over(order) + block, F.lit(folds)).cast("int"))


def fold_of_user(key, folds: int = 5):
    """A user's fold, from a hash of its key, so that a user's rows are never on both sides."""
    return F.pmod(F.xxhash64(key, F.lit(folds)), F.lit(folds)).cast("int")


def class_balance(df: DataFrame, factor: float = 1.0) -> float:
    """Negatives per positive, times a factor."""
    n = df.agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos")).first()
    return factor * n["neg"] / max(n["pos"], 1)


def _pipeline(learner: Learner, names: list[str], aside: str | None = None) -> Pipeline:
    assemble = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="error")
    common = {"featuresCol": "raw", "labelCol": "y", "weightCol": "w"}
    if learner.kind == "boosted":
        stop = {"validationIndicatorCol": aside, "validationTol": 0.001} if aside else {}
        return Pipeline(stages=[assemble, GBTClassifier(maxIter=learner.rounds, maxDepth=learner.depth, stepSize=learner.rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=learner.seed, **common, **stop)])
    if learner.kind == "forest":
        return Pipeline(stages=[assemble, RandomForestClassifier(numTrees=learner.rounds, maxDepth=learner.depth, seed=learner.seed, **common)])
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[assemble, scale, LogisticRegression(regParam=learner.penalty, elasticNetParam=0.0, standardization=False, maxIter=25, tol=1e-5, **(common | {"featuresCol": "scaled"}))])


def prepared(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing values as the sentinel, so that trees can tell them apart; other columns stay."""
    return df.fillna(SENTINEL, names)


def fit(train: DataFrame, names: list[str], learner: Learner, aside: str | None = None):
    """A fitted pipeline; train has y and w and no nulls in names. Boosting stops when the rows that the column ``aside``
    marks are predicted no better."""
    return _pipeline(learner, names, aside).fit(train)


def predict(model, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, F.round(vector_to_array("probability")[1], 6).alias("p"))


def out_of_fold(folded: DataFrame, names: list[str], learner: Learner, ident: str, folds: int = 5, view: View = lambda df, _: df) -> tuple[DataFrame, list]:
    """ident, fold, y, p of every row by the model that has not seen it, and the models.

    The rows that tell boosting when to stop are those of the next fold, so those that it predicts take no part in that.
    """
    models, scores = [], []
    for k in range(folds):
        seen = view(folded, k)
        rest = seen.filter(F.col("fold") != k)
        aside = {"aside": "_aside"} if learner.kind == "boosted" and folds > 2 else {}
        models.append(fit(rest.withColumn("_aside", F.col("fold") == (k + 1) % folds), names, learner, **aside))
        scores.append(predict(models[-1], seen.filter(F.col("fold") == k), ident, "fold", "y"))
    return reduce(DataFrame.unionByName, scores), models


def averaged(models: list, df: DataFrame, ident: str, view: View = lambda df, _: df) -> DataFrame:
    """Mean prediction of the fold models."""
    each = reduce(DataFrame.unionByName, [predict(m, view(df, k), ident) for k, m in enumerate(models)])
    return each.groupBy(ident).agg(F.avg("p").alias("p"))


def blend(predictions: dict[str, DataFrame], ident: str, *keep: str) -> DataFrame:
    """ident, keep, one column per learner, and their mean as blend."""
    first, *rest = [df.select(ident, *(keep if i == 0 else ()), F.col("p").alias(name)) for i, (name, df) in enumerate(predictions.items())]
    joined = reduce(lambda a, b: a.join(b, ident), rest, first)
    return joined.withColumn("blend", reduce(lambda a, b: a + b, [F.col(n) for n in predictions]) / len(predictions))


def stack(blended: DataFrame, names: list[str], ident: str, folds: int = 5) -> tuple[DataFrame, list]:
    """blended with stacked: the out-of-fold prediction of a logistic learner over the learners' predictions; and its models."""
    stacked, models = out_of_fold(blended.withColumn("w", F.lit(1.0)), names, Learner("logistic", penalty=0.0), ident, folds)
    return blended.join(stacked.select(ident, F.col("p").alias("stacked")), ident), models


def better(scores: dict[str, float | None]) -> str:
    """The name with the greater score, the first of equals; an absent score loses."""
    return max(scores, key=lambda n: (scores[n] if scores[n] is not None else float("-inf")))


def importance(model, names: list[str], most: int) -> list[tuple[str, float]]:
    """The most important columns of a tree model, greatest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(((n, float(v)) for n, v in zip(names, values, strict=True)), key=lambda x: (-x[1], x[0]))[:most]


def picks(grid: dict[str, list], trials: int, seed: int = 42) -> list[dict]:
    """The grid's combinations, at most ``trials`` of them, in a shuffled order that is the same at every run."""
    combos = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    Random(seed).shuffle(combos)
    return combos[:trials]


def tune(train: DataFrame, valid: DataFrame, names: list[str], grid: dict[str, list], costs=(600.0, 300.0, 150.0, 5.0), trials: int = 10) -> list[tuple[dict, float, float]]:
    """Parameters, AUC and least cost on held-out rows for at most ``trials`` of the grid's combinations, drawn at random."""
    out = []
    for params in picks(grid, trials):
        weights = {k: v for k, v in params.items() if k in ("positive", "weak_negative")}
        learner = Learner("logistic", **{k: v for k, v in params.items() if k not in weights})
        model = fit(train.withColumn("w", sample_weights(F.col("y"), F.col("weak"), **weights)), names, learner)
        scores = predict(model, valid, "y")
        counted = metrics.by_score(scores).persist()
        steps = metrics.ranks(counted, 50)
        best = metrics.best_thresholds(counted, [(a, b) for i, a in enumerate(steps) for b in steps[i:]], costs, False, True)
        out.append((params, metrics.auc(scores).first()[0] or 0.0, best[2] if best else 0.0))
        counted.unpersist()
    return sorted(out, key=lambda x: x[2])
