"""Training and scoring with MLlib: forests, boosted trees, lasso, importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY_MB = 512


def _assemble(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip")


def forest(df: DataFrame, cols: list[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=MEMORY_MB)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[_assemble(cols), rf]).fit(df)


def boosted(df: DataFrame, cols: list[str], label: str, rounds: int = 5, depth: int = 3, seed: int = 7) -> PipelineModel:
    """Boosted trees for any number of classes, as one binary model per class."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, maxMemoryInMB=MEMORY_MB)
    return Pipeline(stages=[_assemble(cols), OneVsRest(classifier=gbt, featuresCol="features", labelCol=label)]).fit(df)


def regressors(df: DataFrame, cols: list[str], target: str, seed: int = 7) -> dict[str, PipelineModel]:
    """One forest and one boosted regressor for a book target."""
    made = {"forest": RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=10, maxDepth=4, seed=seed, maxMemoryInMB=MEMORY_MB),
            "boosted": GBTRegressor(featuresCol="features", labelCol=target, maxIter=5, maxDepth=3, seed=seed, maxMemoryInMB=MEMORY_MB)}
    return {n: Pipeline(stages=[_assemble(cols), m]).fit(df) for n, m in made.items()}


def per_regime(df: DataFrame, regimes: list[str], cols: list[str], label: str) -> dict[str, PipelineModel]:
    """One forest per regime; the list of regimes is fixed, each fit runs on the whole cluster."""
    return {r: forest(df.where(F.col("regime") == r), cols, label) for r in regimes}


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return out.select(*keep, F.col("prediction").cast("int").alias("predicted"), F.array_max(p).alias("confidence"))
    return out.select(*keep, F.col("prediction").alias("predicted"))


def importances(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Forest importances and absolute lasso coefficients, one row per feature."""
    rf = forest(df, cols, label).stages[-1].featureImportances
    lasso = Pipeline(stages=[_assemble(cols), LinearRegression(
        featuresCol="features", labelCol=label, elasticNetParam=1.0, regParam=0.001, maxIter=50)]).fit(df).stages[-1].coefficients
    rows = [(c, float(rf[i]), float(abs(lasso[i]))) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, forest double, lasso double")
