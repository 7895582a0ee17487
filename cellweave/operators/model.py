"""Pair and mention classifiers on MLlib: features, grouped folds, weights, training and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = {
    "forest": lambda: RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=20, seed=1),
    "boosted": lambda: GBTClassifier(labelCol="label", weightCol="weight", maxIter=10, seed=1),
    "logistic": lambda: LogisticRegression(labelCol="label", weightCol="weight", maxIter=50),
    "svm": lambda: LinearSVC(labelCol="label", weightCol="weight", maxIter=30),
}


def folds(df: DataFrame, group: str, n: int = 10, name: str = "fold") -> DataFrame:
    """Folds that never split a group."""
    return df.withColumn(name, F.pmod(F.xxhash64(group), F.lit(n)).cast("int"))


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight 0.5 / class size, from one small aggregate."""
    sizes = df.groupBy(label).agg((0.5 / F.count("*")).alias("weight"))
    return df.join(F.broadcast(sizes), label)


def assembled(features: list[str], scale: bool = False) -> list:
    stages: list = [VectorAssembler(inputCols=features, outputCol="raw" if scale else "features", handleInvalid="keep")]
    return [*stages, StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)] if scale else stages


def train(df: DataFrame, features: list[str], method: str = "forest"):
    return Pipeline(stages=[*assembled(features, method in ("logistic", "svm")), METHODS[method]()]).fit(df)


def tuned(df: DataFrame, features: list[str], fold: str, n_folds: int, grid: dict[str, list] | None = None):
    """Logistic regression by cross validation on the given folds, by area under the curve."""
    model = METHODS["logistic"]()
    builder = ParamGridBuilder()
    for name, values in (grid or {"regParam": [0.0, 0.1]}).items():
        builder = builder.addGrid(model.getParam(name), values)
    cv = CrossValidator(
        estimator=Pipeline(stages=[*assembled(features, True), model]), estimatorParamMaps=builder.build(),
        evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=n_folds, foldCol=fold,
    )
    return cv.fit(df)


def scored(model, df: DataFrame) -> DataFrame:
    """Adds prob, the probability of class 1."""
    return model.transform(df).withColumn("prob", vector_to_array("probability")[1])


def indexed(df: DataFrame, column: str, out: str) -> DataFrame:
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc").fit(df).transform(df)


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return list(zip(features, map(float, model.stages[-1].featureImportances.toArray())))
