"""Model training with spark.ml (survey M2, M6-M9, M12, C5-C8)."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tails import f_tail, t_quantile


def logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0) -> PipelineModel:
    """M2: standardise, then logistic regression with an L2 penalty of strength 1 / (c n). Null features drop the row."""
    rows = df.dropna(subset=[*features, label])
    n = max(1, rows.count())
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False),
    ]).fit(rows)


def weights(model: PipelineModel, features: list[str]) -> list[tuple[str, float, int]]:
    """M2: (feature, weight, rank by size)."""
    coef = model.stages[-1].coefficients.toArray().tolist()
    order = sorted(range(len(coef)), key=lambda i: -abs(coef[i]))
    return [(features[i], coef[i], order.index(i) + 1) for i in range(len(coef))]


def intercept(model: PipelineModel) -> float:
    """M2."""
    return float(model.stages[-1].intercept)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with the model's probability of class 1 as `score`."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score")


def boosted(df: DataFrame, features: list[str], label: str, folds: int = 3, seed: int = 42) -> PipelineModel:
    """M8: gradient-boosted trees over imputed features and missing flags, depth chosen by cross-validation."""
    flagged = with_flags(df, features)
    filled = [f"{f}_filled" for f in features]
    gbt = GBTClassifier(labelCol=label, maxIter=20, seed=seed)
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled + [f"{f}_missing" for f in features], outputCol="features"), gbt]
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [3, 5]).build()
    search = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"), numFolds=folds, seed=seed)
    return search.fit(flagged).bestModel


def with_flags(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features})


def cross_validated(df: DataFrame, features: list[str], label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """M6: (fold, roc_auc, pr_auc) of logistic models, folds by seeded hash."""
    spark = df.sparkSession
    rows = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(folds)))
    out = []
    for k in range(folds):
        scored = logistic(rows.where(F.col("_fold") != k), features, label).transform(rows.where(F.col("_fold") == k).dropna(subset=features))
        out.append((k, *(BinaryClassificationEvaluator(labelCol=label, metricName=m).evaluate(scored) for m in ("areaUnderROC", "areaUnderPR"))))
    return spark.createDataFrame(out, "fold int, roc_auc double, pr_auc double")


def held_out(df: DataFrame, key: str, share: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows to fit, rows to judge) by a seeded hash of the key: a row's side does not depend on the others."""
    judged = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000)) < int(share * 1000)
    return df.where(~judged), df.where(judged)


def _areas(model: PipelineModel, rows: DataFrame, label: str) -> tuple[float, float]:
    told = model.transform(rows).cache()
    areas = tuple(BinaryClassificationEvaluator(labelCol=label, metricName=m).evaluate(told) for m in ("areaUnderROC", "areaUnderPR"))
    told.unpersist()
    return areas


def single_features(df: DataFrame, key: str, features: list[str], label: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """M2: (feature, weight, intercept, n, roc_auc, pr_auc, rank) of a logistic model of each feature alone on its own complete rows,
    judged on `n` held-out rows and ranked by ROC area, equal ones by name."""
    fit, judge = held_out(df, key, share, seed)
    told = []
    for f in features:
        model, rows = logistic(fit, [f], label), judge.dropna(subset=[f, label])
        told.append((f, weights(model, [f])[0][1], intercept(model), rows.count(), *_areas(model, rows, label)))
    order = sorted(told, key=lambda r: (-r[4], r[0]))
    return df.sparkSession.createDataFrame([(*r, order.index(r) + 1) for r in told], "feature string, weight double, intercept double, n long, roc_auc double, pr_auc double, rank int")


def incremental(df: DataFrame, features: list[str], label: str, key: str | None = None, share: float = 0.3, seed: int = 42) -> DataFrame:
    """M7: PR area as features are added one at a time, on complete cases.

    With a key, models are judged on the rows held_out() by it; without, on the rows they were fitted on.
    """
    rows = df.dropna(subset=[*features, label])
    fit, judge = held_out(rows, key, share, seed) if key else (rows, rows)
    out = [(k, features[k - 1], _areas(logistic(fit, features[:k], label), judge, label)[1]) for k in range(1, len(features) + 1)]
    return df.sparkSession.createDataFrame(out, "k int, added string, pr_auc double")


def learning_curve(df: DataFrame, key: str, features: list[str], label: str, shares: tuple[float, ...] = (0.25, 0.5, 1.0), holdout: float = 0.3, seed: int = 42) -> DataFrame:
    """M9: (share, n, train_pr_auc, pr_auc): PR areas of models fitted on growing hash samples of what is not held out, each sample
    within the next, on the `n` rows fitted and on the held-out rows, which are the same for all."""
    fit, judge = held_out(df.dropna(subset=[*features, label]), key, holdout, seed)
    out = []
    for s in shares:
        rows = fit.where(F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(1000)) < int(s * 1000))
        model = logistic(rows, features, label)
        out.append((s, rows.count(), _areas(model, rows, label)[1], _areas(model, judge, label)[1]))
    return df.sparkSession.createDataFrame(out, "share double, n long, train_pr_auc double, pr_auc double")


def grouped(df: DataFrame, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """K-means cluster of every row."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), KMeans(k=k, seed=seed)]).fit(df).transform(df).drop("features")


def least_squares(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """R2, adjusted R2, F with its p, AIC and BIC of an ordinary least-squares fit with an intercept.

    The information criteria are those of the normal likelihood. F and p are null for an exact fit.
    """
    model, s = _fitted(df, features, target)
    n, p = s.numInstances, len(features)
    log = n * (math.log(2 * math.pi * s.meanSquaredError) + 1) if s.meanSquaredError > 0 else float("-inf")
    free = n - p - 1
    f = s.r2 / p / ((1 - s.r2) / free) if s.r2 < 1 and free > 0 else None
    told = (n, s.r2, s.r2adj, f, None if f is None else f_tail(f, p, free), log + 2 * (p + 1), log + math.log(n) * (p + 1))
    return df.sparkSession.createDataFrame([told], "n long, r2 double, r2_adj double, f double, f_p double, aic double, bic double")


def coefficients(df: DataFrame, features: list[str], target: str, level: float = 0.95) -> DataFrame:
    """(term, coefficient, error, t, p, low, high) of the fit's terms and its intercept; low to high is the
    confidence interval of `level`."""
    model, s = _fitted(df, features, target)
    reach = t_quantile(level, s.degreesOfFreedom)
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    told = [(term, v, e, t, p, v - reach * e, v + reach * e) for term, v, e, t, p in zip([*features, "intercept"], values, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(told, "term string, coefficient double, error double, t double, p double, low double, high double")


def _fitted(df: DataFrame, features: list[str], target: str):
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, target]))
    model = LinearRegression(labelCol=target, solver="normal").fit(rows)
    return model, model.summary


def forest(df: DataFrame, features: list[str], target: str, folds: int = 5, seed: int = 42) -> tuple[float, list[float]]:
    """Cross-validated R2 of a random forest and its importances."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    cv = CrossValidator(estimator=RandomForestRegressor(labelCol=target, seed=seed), estimatorParamMaps=[{}], evaluator=RegressionEvaluator(labelCol=target, metricName="r2"), numFolds=folds, seed=seed).fit(rows)
    return cv.avgMetrics[0], cv.bestModel.featureImportances.toArray().tolist()


def correlation_matrix(df: DataFrame, features: list[str]) -> list[list[float]]:
    """C7."""
    rows = VectorAssembler(inputCols=features, outputCol="v").transform(df.dropna(subset=features)).select("v")
    return Correlation.corr(rows, "v").first()[0].toArray().tolist()


def principal(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows with their first k components, and the explained variance."""
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="std", withMean=True), PCA(k=k, inputCol="std", outputCol="pc")]).fit(df)
    return model.transform(df).drop("raw", "std"), model.stages[-1].explainedVariance.toArray().tolist()
