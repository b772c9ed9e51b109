"""The combined model (survey M8): boosted trees over all feature families, searched, calibrated, explained and saved."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from . import stats

#: What the search draws from.
GRID = {"maxDepth": [2, 3, 5], "maxIter": [10, 20, 40], "stepSize": [0.05, 0.1, 0.3], "subsamplingRate": [0.7, 1.0], "minInstancesPerNode": [1, 5]}


@dataclass
class CombinedModel:
    """A fitted model with all that scoring needs: feature order, what fills gaps, parameters and threshold."""

    features: list[str]
    fills: list[float]
    params: dict
    trees: PipelineModel
    threshold: float = 0.5
    #: (parameters, mean PR area over the folds) of every trial, best first.
    trials: list = field(default_factory=list)

    def scored(self, df: DataFrame) -> DataFrame:
        """`df` with `score` (probability of class 1), `missing` (features that are null) and `is_cluster` (score at or over
        the threshold). Columns may come in any order; a feature without a column is missing in every row."""
        out = self.trees.transform(_vectors(df, self.features, self.fills)).withColumn("_p", vector_to_array("probability")[1])
        missing = sum((F.col(f).isNull().cast("int") if f in df.columns else F.lit(1) for f in self.features), F.lit(0))
        kept = [c for c in df.columns if c not in ("score", "missing", "is_cluster")]
        return out.select(*kept, F.col("_p").alias("score"), missing.alias("missing"), (F.col("_p") >= self.threshold).alias("is_cluster"))

    def importances(self) -> list[tuple[str, float, int]]:
        """(feature, importance, rank): what its values and its gaps add together; all sum to 1, unless no tree has a split."""
        told = self.trees.stages[-1].featureImportances.toArray()
        both = [float(told[i] + told[i + len(self.features)]) for i in range(len(self.features))]
        order = sorted(range(len(both)), key=lambda i: -both[i])
        return [(f, both[i], order.index(i) + 1) for i, f in enumerate(self.features)]

    def save(self, path: str) -> None:
        """The trees, and beside them one line of JSON with the rest."""
        self.trees.write().overwrite().save(f"{path}/trees")
        rest = json.dumps({k: getattr(self, k) for k in ("features", "fills", "params", "threshold", "trials")})
        SparkSession.active().createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CombinedModel:
        return cls(trees=PipelineModel.load(f"{path}/trees"), **json.loads(spark.read.text(f"{path}/rest").first()[0]))


def _vectors(df: DataFrame, features: list[str], fills: list[float]) -> DataFrame:
    """Every feature filled, then whether each was missing."""
    value = lambda f: F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
    filled = {f"_f{i}": F.coalesce(F.nanvl(value(f), F.lit(None)), F.lit(x)) for i, (f, x) in enumerate(zip(features, fills))}
    return df.withColumns(filled | {f"_m{i}": F.isnull(F.nanvl(value(f), F.lit(None))).cast("double") for i, f in enumerate(features)})


def fitted(df: DataFrame, features: list[str], label: str, params: dict, seed: int = 42) -> CombinedModel:
    """Boosted trees with given parameters. Gaps are filled with the column's mean (0 where it has none) and flagged."""
    means = df.agg(*[F.coalesce(F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None))), F.lit(0.0)) for f in features]).first()
    fills = [float(x) for x in means]
    cols = [f"_f{i}" for i in range(len(features))] + [f"_m{i}" for i in range(len(features))]
    rows = VectorAssembler(inputCols=cols, outputCol="_features")
    trees = GBTClassifier(labelCol="_label", featuresCol="_features", seed=seed, **params)
    ready = rows.transform(_vectors(df.withColumn("_label", F.col(label).cast("double")), features, fills))
    return CombinedModel(list(features), fills, dict(params), PipelineModel([rows, trees.fit(ready)]))


def out_of_fold(df: DataFrame, key: str, features: list[str], label: str, params: dict, folds: int = 3, seed: int = 42) -> DataFrame:
    """`df` with `fold` (by the key's seeded hash) and `score` by a model that was fitted on the other folds."""
    dealt = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))
    out = None
    for k in range(folds):
        model = fitted(dealt.where(F.col("fold") != k), features, label, params, seed)
        part = model.scored(dealt.where(F.col("fold") == k)).drop("missing", "is_cluster")
        out = part if out is None else out.unionByName(part)
    return out


def drawn(grid: dict[str, list], trials: int, seed: int) -> list[dict]:
    """`trials` different parameter sets of the grid, all of them if it has no more."""
    every = [dict(zip(grid, x)) for x in product(*grid.values())]
    return random.Random(seed).sample(every, min(trials, len(every)))


def calibrated(scores: DataFrame, score: str, label: str, part: str, steps: int = 19) -> tuple[float, float]:
    """(threshold, value): of the thresholds 0.05 to 0.95 the one with the greatest 0.5 F1 of the rows whose part is `test` + 0.5 recall
    of those whose part is `validation`; the lowest of equal ones. Without validation rows their recall counts 0.

    Scores are binned and counted in Spark; a row for each threshold reaches the driver.
    """
    sweep = stats.threshold_sweep(scores, score, label, part, steps)
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    told = sweep.groupBy("threshold").agg(F.max(F.when(F.col("g") == "test", F.col("f1"))).alias("f"), F.max(F.when(F.col("g") == "validation", recall)).alias("r"))
    both = {r["threshold"]: 0.5 * (r["f"] or 0.0) + 0.5 * (r["r"] or 0.0) for r in told.collect()}
    return max(sorted(both.items()), key=lambda x: round(x[1], 12)) if both else (0.5, 0.0)


def train_combined(df: DataFrame, key: str, features: list[str], label: str, holdout: Column, *, grid: dict[str, list] | None = None, trials: int = 8, folds: int = 3, ratio: float = 0.3, seed: int = 42) -> tuple[CombinedModel, DataFrame]:
    """M8: (model, scores of all rows with their part): split, search, fit, calibrate.

    Held-out rows are validation and never fitted; the rest is split by label into train and test. Trials are drawn from the grid
    by seed and judged by the mean PR area of their out-of-fold scores on the training rows; the first of equal ones wins and is
    fitted on all of these. The threshold is calibrated on test and validation rows. Rows without a label are left out.
    """
    parts = cut(stats.split(df.where(F.col(label).isNotNull()), key, label, holdout, ratio, seed))
    train = parts.where("part = 'train'")
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="_y", metricName="areaUnderPR")
    told = []
    for params in drawn(grid or GRID, trials, seed):
        scores = cut(out_of_fold(train, key, features, label, params, folds, seed).select("fold", "score", F.col(label).cast("double").alias("_y")))
        areas = [judge.evaluate(scores.where(F.col("fold") == k)) for k in range(folds)]
        told.append((params, sum(areas) / folds))
    told.sort(key=lambda x: -x[1])
    model = fitted(train, features, label, told[0][0], seed)
    model.trials = told
    scores = model.scored(parts)
    model.threshold, _ = calibrated(scores, "score", label, "part")
    return model, model.scored(parts)
