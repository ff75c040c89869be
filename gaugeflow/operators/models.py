"""Regressions per target with cross-validation by groups, and batch prediction with intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators import features

SEED = 42


def regressors(trees: int = 200, rounds: int = 100) -> dict:
    """The models that are compared, by name; the boosted trees stand in for an outside library's."""
    given = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "predicted"}
    return {
        "Linear Regression": LinearRegression(**given),
        "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=15, minInstancesPerNode=5, seed=SEED, **given),
        "Boosted Trees": GBTRegressor(maxIter=rounds, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, seed=SEED, **given),
    }


def _prepared(df: DataFrame, columns: list[str], target: str | None) -> DataFrame:
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return rows if target is None else rows.where(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))


def fit(df: DataFrame, columns: list[str], target: str, model) -> Model:
    """A fitted pipeline: columns to a vector, then the model."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), model]).fit(_prepared(df, columns, target))


def predict(df: DataFrame, columns: list[str], fitted: Model) -> DataFrame:
    """``df`` with ``predicted`` and, of a forest, ``low`` and ``high``: p5 and p95 of its trees.

    Rows that lack a column are left out.
    """
    given = _prepared(df, columns, None)
    model = fitted.stages[-1]
    out = fitted.transform(given)
    trees = getattr(model, "trees", None)
    if trees is None or model.__class__.__name__ != "RandomForestRegressionModel":
        return out.select(*df.columns, "predicted", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    for i, tree in enumerate(trees):
        out = tree.setFeaturesCol("_x").setPredictionCol(f"_t{i}").transform(out)
    ends = features.ensemble_interval(F.array(*[f"_t{i}" for i in range(len(trees))]))
    return out.withColumn("_e", ends).select(*df.columns, "predicted", F.col("_e.low").alias("low"), F.col("_e.high").alias("high"))


def cross_validated(df: DataFrame, columns: list[str], target: str, group: str, model, k: int = 5) -> DataFrame:
    """R2, RMSE and MAE of predictions for groups that the model wasn't fitted on."""
    rows = _prepared(df, columns, target)
    folds = features.group_folds(rows, group, k)
    dealt = rows.join(folds, group)
    parts = [predict(dealt.where(F.col("fold") == i), columns, fit(dealt.where(F.col("fold") != i), columns, target, model)) for i in range(k)]
    every = reduce(DataFrame.unionByName, parts)
    return features.regression_metrics(every.withColumn("target", F.lit(target)), ["target"], target, "predicted")


def linear_terms(fitted: Model, columns: list[str]) -> dict[str, float]:
    """Coefficients of a fitted linear model by column, and its intercept."""
    model = fitted.stages[-1]
    return dict(zip(columns, model.coefficients.toArray().tolist())) | {"intercept": float(model.intercept)}


def importances(fitted: Model, columns: list[str]) -> list[tuple[str, float]]:
    """Columns by falling importance in a fitted forest."""
    values = fitted.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(columns, values), key=lambda p: (-p[1], p[0]))


