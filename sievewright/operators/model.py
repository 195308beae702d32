"""Weighted logistic regression, scoring, and the train/tune protocol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.balance import class_weights, with_weights
from sievewright.operators.metrics import best_threshold
from sievewright.operators.split import stratified_split
from sievewright.session import staging_path


def train_logistic_regression(
    df: DataFrame, features: list[str], target: str, weights: DataFrame | None = None,
    c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6,
) -> PipelineModel:
    """L2-penalised fit of ``|b|^2 / 2 + c * sum(w * loss)`` with a free intercept.

    The library minimises the weighted mean loss, so the penalty is divided by the total
    weight. Without given weights the classes are balanced.
    """
    weights = class_weights(df, target) if weights is None else weights
    rows = with_weights(df.select(target, *features), target, weights, "_w")
    total = rows.agg(F.sum("_w")).first()[0]
    assembler = VectorAssembler(inputCols=features, outputCol="features_vec")
    fit = LogisticRegression(
        featuresCol="features_vec", labelCol=target, weightCol="_w", standardization=False,
        regParam=1.0 / (c * total), elasticNetParam=0.0, maxIter=max_iter, tol=tol,
        aggregationDepth=3,
    ).fit(assembler.transform(rows).select("features_vec", target, "_w"))
    # a fitted model holds the session through its training summary and cannot be sent to tasks once the session has
    # observed a frame; read back from its files it holds its numbers alone
    path = staging_path(df.sparkSession, "model")
    fit.save(path)
    return PipelineModel([assembler, LogisticRegressionModel.load(path)])


MODELS = {"lr": ("Logistic Regression", train_logistic_regression)}


def score(df: DataFrame, model: PipelineModel, task: str = "binary") -> DataFrame:
    """Add ``p`` (binary, attack class) or ``probabilities`` and ``prediction``."""
    scored = model.transform(df)
    values = vector_to_array(F.col("probability"))
    if task == "binary":
        scored = scored.withColumn("p", values[1])
    else:
        scored = scored.withColumn("probabilities", values)
    scored = scored.withColumn("prediction", F.col("prediction").cast("int"))
    return scored.drop("features_vec", "rawPrediction", "probability")


def binary_from_codes(df: DataFrame, target: str) -> DataFrame:
    """Any attack class becomes 1."""
    return df.withColumn(target, (F.col(target) > 0).cast("int"))


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    threshold: float
    tuning: dict | None  # best row of the threshold sweep
    task: str


def fit_and_tune(
    train: DataFrame, features: list[str], target: str, task: str = "binary",
    model: str = "lr", threshold: float = 0.5, tune: bool = False, tune_size: float = 0.1,
    seed: int = 42, key: str = "row_id", weights: DataFrame | None = None,
) -> Fitted:
    """Fit on all training rows, or fit on a part and tune the threshold on the rest.

    Tuning is for binary tasks; weights are then balanced on the fitted part, and the model is
    not refitted afterwards.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; use one of {list(MODELS)}")
    trainer = MODELS[model][1]
    if task == "binary":
        train = binary_from_codes(train, target)
        weights = None
    if not (tune and task == "binary"):
        return Fitted(trainer(train, features, target, weights), threshold, None, task)
    parts = stratified_split(train.drop("split"), target, tune_size, 0.0, seed, key)
    fitted = trainer(parts.filter(F.col("split") == "train"), features, target)
    held_out = score(parts.filter(F.col("split") == "test"), fitted)
    best = best_threshold(held_out, target, "p").first().asDict()
    return Fitted(fitted, best["threshold"], best, task)


def predict(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Score and decide; only binary tasks use the threshold."""
    scored = score(df, fitted.model, fitted.task)
    if fitted.task != "binary":
        return scored
    return scored.withColumn("prediction", (F.col("p") >= F.lit(fitted.threshold)).cast("int"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def coefficients(model: PipelineModel) -> LogisticRegressionModel:
    """The regression stage of a fitted pipeline."""
    return model.stages[-1]
